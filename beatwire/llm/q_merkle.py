"""Operator 12: Merkle dataset manifest."""

import string

from beatwire.llm.merkle import verified_manifest
from beatwire.llm.registry import query, table
from beatwire.llm.sql import crc32_sql

LEVELS = 7  # of a language's tree, and of the tree above: 8**7 rows, for the small tables


def _framed(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in (
        "doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, key: str, nodes: str) -> str:
    """CTEs name_0..name_LEVELS: (key, p, h, kids), n being the leaves of a key."""
    out = [f"{name}_0 AS ({nodes})"]
    for i in range(1, LEVELS + 1):
        out.append(f"""{name}_{i} AS (SELECT {key}, n, p // 8 AS p,
  CASE WHEN n > {8 ** (i - 1)} THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h,
  list(h ORDER BY p) AS kids FROM {name}_{i - 1} GROUP BY {key}, n, p // 8)""")
    return ",\n".join(out)


def _climb(name: str, key: str, first: str) -> str:
    """CTEs name_up_0..: rows that gather siblings and fold, level by level."""
    out = [f"{name}_up_0 AS ({first})"]
    for i in range(1, LEVELS + 1):
        left = "array_to_string(t.kids[1:(u.p % 8)], '')"
        right = "array_to_string(t.kids[(u.p % 8 + 2):], '')"
        out.append(f"""{name}_up_{i} AS (SELECT u.* EXCLUDE (p, proof, fold), u.p // 8 AS p,
  CASE WHEN t.n > {8 ** (i - 1)} THEN u.proof || {left} || {right} ELSE u.proof END AS proof,
  CASE WHEN t.n > {8 ** (i - 1)} THEN sha256({left} || u.fold || {right}) ELSE u.fold END AS fold
  FROM {name}_up_{i - 1} u JOIN {name}_{i} t ON t.{key} IS NOT DISTINCT FROM u.{key}
    AND t.p = u.p // 8)""")
    return ",\n".join(out)


SQL = f"""WITH marked AS (SELECT *, {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 AS hit FROM documents),
leaves AS (SELECT doc_id, lang, {_leaf('text')} AS leaf,
  CASE WHEN hit THEN {_leaf(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")}
    ELSE {_leaf('text')} END AS start FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
  count(*) OVER (PARTITION BY lang) AS n FROM leaves),
{_tree('low', 'lang', "SELECT lang, n, p, leaf AS h, NULL::VARCHAR[] AS kids FROM placed")},
subs AS (SELECT lang, h, 1 AS one, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p,
  count(*) OVER () AS n FROM low_{LEVELS}),
{_tree('top', 'one', "SELECT one, n, p, h, NULL::VARCHAR[] AS kids FROM subs")},
{_climb('low', 'lang', "SELECT doc_id, lang, leaf, p, '' AS proof, start AS fold FROM placed")},
{_climb('top', 'one', f"SELECT u.* EXCLUDE (p), s.p, s.one, s.h AS subroot FROM low_up_{LEVELS} u "
        "JOIN subs s ON s.lang IS NOT DISTINCT FROM u.lang")}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
  fold = r.h AS verified FROM top_up_{LEVELS} u JOIN top_{LEVELS} r ON r.one = u.one"""


@query("op12_merkle", SQL)
def op12_merkle(spark, sf_dir):
    return verified_manifest(table(spark, sf_dir, "documents"))
