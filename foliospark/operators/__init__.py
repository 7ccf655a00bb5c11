"""DataFrame operators over documents, chunks, fields, filings and logs."""
