"""Training-data operators: text, page and conversation tables at corpus scale."""
