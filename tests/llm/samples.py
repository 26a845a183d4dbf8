"""Small document tables of the tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: A hundred words that repeat nothing of each other.
PROSE = " ".join(f"word{i}x{i * i}" for i in range(100))


def rows(*texts, source="s"):
    return [(i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)]


def edge_rows():
    """Null and empty texts, a null id and source, a repeated row, a very long text, ties."""
    long = " ".join(f"l{i % 977}" for i in range(60_000))
    return [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, PROSE, "en", "a", len(PROSE)),
        (3, PROSE, "en", "a", len(PROSE)),
        (4, PROSE, "en", "b", len(PROSE)),
        (None, "no id " + PROSE, "en", "b", None),
        (5, long, "en", "b", len(long)),
        (6, " \n\t ", "en", "c", 4),
        (7, "é" * 150, "en", "c", 150),
    ]
