"""Small fixtures with every awkward case."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The table with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    for name in ("id", "_id", "_d", "_n", "n", "rep", "blob", "path", "found", "doc", "h1", "h2", "gone", "kept", "keep_id", "component_id", "bucket", "rank", "length", "piece", "word", "label", "conv", "example", "d", "v", "kind", "score", "toxic", "ids", "f", "y", "_doc", "_gone", "_kept", "_key", "_blob", "_found", "_b", "_p", "_text"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(f"x-{name}"))
    return df


AWKWARD = [
    None,
    "",
    " \t\n\x0b\f\r ",
    "one",
    "One  two\tthree",
    "One two three",
    "one two three\n",
    "a line of more than twenty characters\nother\nA LINE of more than twenty characters  \n",
    "a line of more than twenty characters",
    "  a line of more than twenty characters",
    "x" * 30_000,
    "word " * 9_000,
    "Été \U0001f600 naïve ▁ mark \x1c sep ﬁ",
    "password=abcdefgh1 token: short api_key = 'ABCDEFGHIJ' secret=token=abcdefgh \U0001f600 token=zzzzzzzzzz",
    "AKIAABCDEFGHIJKL AKIASHORT " + "0123456789abcdef" * 3 + " " + "f" * 31,
    "ghp_" + "a1B2" * 10 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890-abcdef",
    "Released under the MIT License. This work is licensed under the GNU General Public License, version 3",
    "CC BY 4.0, apache license and mit license mit license",
    "the quick brown fox jumps over the lazy dog again and again until it is very tired of all that jumping around here",
    "The quick brown fox jumps over the lazy dog again and again until it is very tired of all that jumping around here",
    "the quick brown fox jumps over the lazy dog again and again until it is very tired of all that jumping around there",
    "</s>[INST] <|endoftext|> <<SYS>> \\ <\\ [\\/INST]",
    "the the the the the the the the",
    "hello <|endoftext|> world<|startoftext|>, <|ENDOFTEXT|> a<|endoftext|>b <|endoftext|><|endoftext|>",
]
