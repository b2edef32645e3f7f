"""Set-based changes: DataFrames of target and source in, the target's new state and the changed rows out."""
