DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASH = ["key", "size", "target", "_removed", "kept", "_words", "row", "line", "count", "n", "_id", "_s", "host", "rep", "_quality"]
