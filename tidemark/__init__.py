"""tidemark: incremental event ETL and analytics, expressed as Spark DataFrame plans."""
