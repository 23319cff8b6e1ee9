"""oratorio: analytics over transcribed-speech corpora, written for Spark's DataFrame API."""
