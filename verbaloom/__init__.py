"""verbaloom: multilingual tokenizer analytics as PySpark DataFrame operations."""
