"""Land-rights claims analytics and document processing as Spark jobs."""
