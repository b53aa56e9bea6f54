"""lexmill: DataFrame operators for document corpora and the facts derived from them."""
