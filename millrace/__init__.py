"""millrace: transcript and entity analytics as DataFrame-to-DataFrame operators on Spark."""
