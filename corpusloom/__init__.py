"""corpusloom: building, filtering and measuring paired speech-text corpora on Spark."""
