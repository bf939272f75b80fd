"""Row, series, stream and chunk operators over DataFrames."""
