"""Operator 11: conversation structure repair."""

from beatwire.llm.conversations import repair_damaged
from beatwire.llm.registry import query, table
from beatwire.llm.sql import crc32_sql

FAR = 1_000_000_000  # cost of an edit that is not allowed


def _edits(p: int, after: int, keep: str) -> str:
    """The cheapest (cost, letters, lines) from a position over one row, without insertions."""
    role = ("user", "assistant")[p == 2]
    keep_to = f"CASE WHEN init = 's' THEN r.o1 ELSE r.o{after} END" if p == 0 else f"r.o{after}"

    def option(cost: str, letter: str, to: str, line: str) -> str:
        return (f"{{'c': {cost} + ({to}).c, 'a': '{letter}' || ({to}).a, "
                f"'t': {line} || ({to}).t}}")

    go = "CASE WHEN must_go THEN {} ELSE {} END"
    return f"""list_sort([{option("3", "D", f"r.o{p}", "''")},
  {option(go.format(FAR, f"CASE WHEN {keep} THEN cut ELSE {FAR} END"), "K", keep_to, "chr(10) || role || ':' || text")},
  {option(go.format(FAR, "2 + cut"), "R", f"r.o{after}", f"chr(10) || '{role}:' || text")}])[1]"""


def _insert(own: str, to: str, role: str) -> str:
    return (f"list_sort([{own}, {{'c': 2 + {to}.c, 'a': 'I' || {to}.a, "
            f"'t': chr(10) || '{role}:' || {to}.t}}])[1]")


def _end(cost: int, letters: str, lines: str) -> str:
    return f"{{'c': {cost}::BIGINT, 'a': '{letters}', 't': {lines}}}"


INK = r"[^\x20\x09-\x0D]"
SQL = rf"""WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM marked WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM numbered),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{INK}') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS init FROM seen),
facts AS (SELECT *, fault IN ('blank', 'duplicate') AS must_go, CAST(fault = 'truncated' AS INT) AS cut,
    lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faults),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal
  FROM facts GROUP BY conv_id),
back AS (
  SELECT conv_id, max(i) AS i, {_end(0, '', "''")} AS o0,
    {_end(4, 'II', "chr(10) || 'user:' || chr(10) || 'assistant:'")} AS o1,
    {_end(2, 'I', "chr(10) || 'assistant:'")} AS o2, {_end(0, '', "''")} AS o3
  FROM facts GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, {_insert('e0', 'f2', 'user')} AS o0, {_insert('e1', 'f2', 'user')} AS o1, f2 AS o2, f3 AS o3
  FROM (SELECT *, {_insert('e2', 'e3', 'assistant')} AS f2, {_insert('e3', 'e2', 'user')} AS f3
    FROM (SELECT r.conv_id, r.i - 1 AS i, {_edits(0, 2, "init IN ('s', 'u')")} AS e0,
      {_edits(1, 2, "init = 'u'")} AS e1, {_edits(2, 3, "init = 'a'")} AS e2, {_edits(3, 2, "init = 'u'")} AS e3
      FROM back r JOIN facts f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.o0.c, 0) AS cost,
  coalesce(b.o0.a, '') AS audit, sha256(coalesce(b.o0.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 0"""


@query("op11_conversations", SQL)
def op11_conversations(spark, sf_dir):
    return repair_damaged(table(spark, sf_dir, "conversations"))
