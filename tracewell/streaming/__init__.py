"""Structured Streaming forms of the batch jobs: files in, checkpointed progress, keyed results out."""
