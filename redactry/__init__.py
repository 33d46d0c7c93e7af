"""redactry: sensitive-data detection, masking and risk analytics as Spark plans."""
