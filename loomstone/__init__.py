"""loomstone: conversational-memory and text analytics as Spark plans."""
