"""Values that several test modules share."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"

#: Texts at the edges: null, empty, blank, one word, odd white space, repeated rows, no id.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "a\x0bb c  d"), (None, "no id here at all"), (None, None)]
