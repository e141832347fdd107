"""tracequarry: a PySpark-native analytics engine for agent traces and transcripts."""
