"""Document-to-table analytics on Spark: lazy DataFrame operators over cases, exhibits, pages and events."""
