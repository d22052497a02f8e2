"""Set-at-a-time graph operators; every one takes and returns DataFrames."""
