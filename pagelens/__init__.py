"""pagelens: analytics over transcribed document pages, expressed as Spark plans."""
