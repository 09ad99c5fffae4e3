"""lectern: DataFrame operators for large collections of timed transcripts."""
