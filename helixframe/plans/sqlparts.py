"""DuckDB SQL fragments shared by several oracles (twins of the Spark
expressions in ``helixframe.functions`` and ``helixframe.operators``)."""

from __future__ import annotations

from helixframe.operators.tokens import BERT_SPECIALS, CJK_CLASS, ESM_ALPHABET, RESIDUE_ORDER

PUNCT = r"[\p{P}!-/:-@\[-`{-~]"


def overlap_words(text: str, w: int, o: int) -> str:
    if o >= w:
        return "([]::VARCHAR[])"
    return (f"(CASE WHEN length({text}) <= {o} THEN []::VARCHAR[] ELSE "
            f"list_transform(range(0, length({text}) - {o}, {w - o}), "
            f"lambda i: substring({text}, i + 1, {w})) END)")


def overlap_string(text: str, w: int, o: int) -> str:
    return f"array_to_string({overlap_words(text, w, o)}, ' ')"


def chars(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: substring({text}, i, 1))"


def bert_normalize(text: str) -> str:
    s = f"regexp_replace({text}, '[\\x00\\x{{FFFD}}]|[^\\P{{C}}\\t\\n\\r]', '', 'g')"
    s = f"regexp_replace({s}, '[\\t\\n\\r\\p{{Z}}]', ' ', 'g')"
    s = f"regexp_replace({s}, '({CJK_CLASS})', ' \\1 ', 'g')"
    return f"strip_accents(lower({s}))"


def bert_pretokenize(text: str) -> str:
    return f"regexp_extract_all({text}, '{PUNCT}|[^ \\p{{P}}!-/:-@\\[-`{{-~]+')"


def str_list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


ESM_LIST = str_list(ESM_ALPHABET)
RESIDUE_LIST = str_list(RESIDUE_ORDER)
SPECIALS_LIST = str_list(BERT_SPECIALS)


def residue_seq(text: str) -> str:
    """Protein-like residue string derived from prose: ASCII letters, upper."""
    return f"upper(regexp_replace({text}, '[^A-Za-z]', '', 'g'))"


def md5_ints(lst: str) -> str:
    return f"md5(array_to_string({lst}, ','))"
