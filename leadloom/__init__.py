"""leadloom: lead and web-audit analytics as Spark DataFrame transformations."""
