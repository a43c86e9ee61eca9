"""Shared pieces of the oracle SQL (DuckDB): the analyzer written a second way.

DuckDB's regular expressions know no look-around.  Marks that join two letters
or two digits are first swapped for private-use characters, which then count as
word characters, and are swapped back in the tokens.
"""

from __future__ import annotations

_LETTER = {".": "", "'": "", ":": "", "’": "", "·": ""}
_DIGIT = {".": "", ",": "", ";": "", "'": "", "’": ""}


def _q(text: str) -> str:
    return text.replace("'", "''")


def _marked(column: str) -> str:
    out = column
    for kind, marks in (("L", _LETTER), ("N", _DIGIT)):
        for mark, stand_in in marks.items():
            pattern = rf"(\p{{{kind}}})[{_q(mark)}](\p{{{kind}}})"
            for _ in range(2):  # matches overlap at one-character words
                out = rf"regexp_replace({out}, '{pattern}', '\1{stand_in}\2', 'g')"
    return out


def _restored(column: str) -> str:
    marks = {**{v: k for k, v in _LETTER.items()}, **{v: k for k, v in _DIGIT.items()}}
    return f"translate({column}, '{''.join(marks)}', '{_q(''.join(marks.values()))}')"


def token_ctes(source: str = "SELECT doc_id, text FROM documents", name: str = "tok") -> str:
    """CTEs that end in ``name(doc_id, tokens)`` of a (doc_id, text) source."""
    word = r"[\p{L}\p{N}\p{M}_" + "".join(dict.fromkeys([*_LETTER.values(), *_DIGIT.values()])) + "]+"
    return rf"""
{name}_raw AS (SELECT doc_id, lower(coalesce(text, '')) AS t, NOT regexp_matches(coalesce(text, ''), '[^\x00-\x7F]') AS plain FROM ({source})),
{name}_marked AS (SELECT doc_id, plain, CASE WHEN plain THEN t ELSE {_marked("t")} END AS t FROM {name}_raw),
{name} AS (SELECT doc_id, CASE
    WHEN plain THEN list_filter(regexp_extract_all(t, '[a-z0-9_]+'), lambda x: len(x) >= 2)
    ELSE list_filter(list_transform(regexp_extract_all(t, '{word}'), lambda x: {_restored("x")}), lambda x: len(x) >= 2 AND regexp_matches(x, '[\p{{L}}\p{{N}}]')) END AS tokens
  FROM {name}_marked)"""


def posting_ctes(tok: str = "tok") -> str:
    return f"""
post AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM {tok}) GROUP BY term, doc_id)"""


def all_terms(terms: list[str], tok: str = "tok") -> str:
    """Documents of ``tok`` that hold each term."""
    return f"SELECT doc_id FROM {tok} WHERE " + " AND ".join(f"list_contains(tokens, '{t}')" for t in terms)


def phrase(words: list[str], tok: str = "tok") -> str:
    return f"SELECT doc_id FROM {tok} WHERE contains('|' || array_to_string(tokens, '|') || '|', '|{'|'.join(words)}|')"


def scored(terms: list[str], also: str = "SELECT doc_id FROM tok") -> str:
    """CTE ``scored(doc_id, score)`` by BM25 over documents that hold all terms."""
    # one order of addition: equal documents get equal scores
    added = " + ".join(f"max(p) FILTER (term = '{t}')" for t in sorted(terms))
    named = ", ".join(f"'{t}'" for t in terms)
    return f"""
corpus AS (SELECT count(*) AS n, sum(len(tokens)) AS total FROM tok),
hit AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(tokens, lambda x: x IN ({named}))) AS term FROM tok) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
part AS (SELECT h.doc_id, h.term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.2::DOUBLE
                               / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens) / (total / n::DOUBLE))) AS p
  FROM hit h JOIN freq USING (term) JOIN tok USING (doc_id), corpus WHERE h.doc_id IN ({also})),
scored AS (SELECT doc_id, {added} AS score FROM part GROUP BY doc_id HAVING count(*) = {len(terms)})"""
