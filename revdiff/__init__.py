"""revdiff: find and report what changed between two revisions of structured documents, as Spark jobs."""
