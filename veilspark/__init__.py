"""veilspark: stream anonymisation, privacy checks and latency analytics as Spark plans."""
