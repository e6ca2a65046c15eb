"""PySpark-native engine for finding and ranking moments in timed transcripts and sampled visual signals."""
