"""Small SQL fragments for the statements the Spark results are compared with."""

NL = "chr(10)"


def S(x: str) -> str:
    """Trim whitespace of any kind."""
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def WC(x: str) -> str:
    """Number of words."""
    return rf"len(regexp_extract_all({x}, '\S+'))"


def CNT(x: str, pattern: str) -> str:
    """Number of matches."""
    return f"len(regexp_extract_all({x}, '{q(pattern)}'))"


def q(s: str) -> str:
    return s.replace("'", "''")


def TOK(words: str, factor: str = "1.33") -> str:
    """Estimated tokens of that many words."""
    return f"greatest(CAST(trunc({words} * {factor}::DOUBLE) AS INTEGER), 1)"


def SENT(x: str) -> str:
    """List of sentences; RE2 has no look-behind, so a control character marks the cut."""
    cut = rf"regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda z: {S('z')}), lambda z: z <> '')"


def LIKE_ANY(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, '{q(n)}')" for n in needles) + ")"


def CASE_CONTAINS(x: str, table, otherwise: str) -> str:
    whens = " ".join(f"WHEN {LIKE_ANY(x, needles)} THEN '{label}'" for label, needles in table)
    return f"CASE {whens} ELSE '{otherwise}' END"


def CASE_REGEX(x: str, table, otherwise: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, '{q(p)}') THEN '{label}'" for label, p in table)
    return f"CASE {whens} ELSE '{otherwise}' END"


def duck(sql: str) -> str:
    """The form without the braces Spark uses for table names."""
    import re

    return re.sub(r"\{(\w+)\}", r"\1", sql)
