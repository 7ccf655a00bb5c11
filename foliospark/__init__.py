"""Document-table analytics on Spark: DataFrame operators over documents, chunks, fields and filings."""
