"""Wiki markup: a tokenizer, table-producing extractors and template expansion."""
