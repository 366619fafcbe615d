"""quaywise: payables reconciliation analytics for import shipments, as Spark DataFrames."""
