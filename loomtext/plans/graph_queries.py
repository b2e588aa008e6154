"""Queries over the graph of equal words: its nodes and edges with SQL, plain and with citations as one unit, and its matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import overlap as O, pairs as G
from loomtext.plans.overlap_queries import B, BT, D, DT, FOLD, W, gram_sql
from loomtext.session import table

#: Citations put behind words of two kinds, the same in documents and benchmark items.
CITED = ((r"( [a-m][a-z]*(?:tion|ment)) ", "(Stone, 2004)"), (r"( [n-z][a-z]*(?:tion|ment)) ", "(Reed, 1999)"))


def _sides(spark, d):
    return table(spark, d, "documents").select("doc_id", "text"), O.sources_of(table(spark, d, "benchmark"))


def pair_graph_nodes(spark, d):
    """Places of equal words of manuscripts and sources that may lie in one match."""
    m, s = (G.plain_side(x) for x in _sides(spark, d))
    return G.nodes(m, s).select("m", "s", "mi", "si", "i", "j")


def pair_graph_edges(spark, d):
    """Every such place with each that may follow it directly in a match."""
    m, s = (G.plain_side(x) for x in _sides(spark, d))
    found = G.following(G.nodes(m, s)).withColumn("y", F.explode("after"))
    return found.select("m", "s", "i", "j", F.col("y.i").alias("yi"), F.col("y.j").alias("yj"))


def with_citations(docs):
    text = F.col("text")
    for pattern, mark in CITED:
        text = F.regexp_replace(text, pattern, f"$1 {mark} ")
    return docs.select("doc_id", text.alias("text"))


def citation_units(spark, d):
    """Author–year citations of the cited documents as token ranges, with their words."""
    return G.cited_units(with_citations(_sides(spark, d)[0])).where("unit").select("doc_id", "i", "n", "w")


def cited_pair_nodes(spark, d):
    """Nodes of the graph where whole citations count as one unit."""
    m, s = (G.cited_side(with_citations(x)) for x in _sides(spark, d))
    return G.nodes(m, s, 4).select("m", "s", "i", "j", "n", "unit")


def cited_graph_matches(spark, d):
    """Matches that take equal citations whole or not at all."""
    m, s = (G.cited_side(with_citations(x)) for x in _sides(spark, d))
    return G.matches(m, s, fewest=4).drop("shift")


def _telling(w: str) -> str:
    return rf"({w} IN ({', '.join(map(repr, T.STATISTICS))}) OR regexp_full_match({w}, '[0-9]+(?:[.,][0-9]+)*') OR (regexp_full_match({w}, '\p{{L}}+') AND length({w}) >= 2 AND {w} NOT IN ({', '.join(map(repr, T.STOPWORDS))})))"


def _side(name: str, source: str, at: str, fewest: int) -> str:
    """Islands of the live units `source` (m, s, at, n, w): every stretch of an island is tried, and a unit stays if one holds it."""
    return f"""{name}1 AS (SELECT *, sum(CASE WHEN {at} - p <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY m, s ORDER BY {at}) AS k FROM (SELECT *, lag({at} + n) OVER (PARTITION BY m, s ORDER BY {at}) AS p FROM {source})),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY m, s, k ORDER BY {at}) AS r, sum(n) OVER (PARTITION BY m, s, k ORDER BY {at}) AS c FROM {name}1),
{name}3 AS (SELECT x.m, x.s, x.k, x.r AS lo, max(y.r) AS hi FROM {name}2 x JOIN {name}2 y ON x.m = y.m AND x.s = y.s AND x.k = y.k AND y.r >= x.r + {fewest - 1}
  WHERE 5 * (y.c - x.c + x.n) >= 3 * (y.{at} + y.n - x.{at}) GROUP BY ALL),
{name}4 AS (SELECT * FROM {name}2 x WHERE EXISTS (SELECT 1 FROM {name}3 y WHERE x.m = y.m AND x.s = y.s AND x.k = y.k AND x.r BETWEEN y.lo AND y.hi)),
{name}5 AS (SELECT *, lag({at} + n) OVER (PARTITION BY m, s ORDER BY {at}) AS q FROM {name}4),
{name}6 AS (SELECT *, sum(CASE WHEN {at} - q <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY m, s ORDER BY {at}) AS z FROM {name}5),
{name} AS (SELECT m, s, {at}, n, w, min({at}) OVER (PARTITION BY m, s, z) AS {name}i FROM {name}6)"""


def _graph(units: str, fewest: int) -> str:
    """Nodes from unit tables dn (m, i, n, w, g) and bn (s, j, n, w, g), g null where no three touching words start."""
    return f"""{units},
sd AS (SELECT m, s, i, j FROM dn JOIN bn USING (g) WHERE len(list_filter(string_split(g, ' '), lambda x: {_telling('x')})) > 0),
pr AS (SELECT DISTINCT m, s FROM sd),
lm AS (SELECT pr.m, pr.s, i, n, w FROM pr JOIN dn USING (m) JOIN (SELECT DISTINCT s, n, w FROM bn) USING (s, n, w)),
{_side('m', 'lm', 'i', fewest)},
ls AS (SELECT k.m, k.s, j, n, w FROM (SELECT DISTINCT m, s, n, w FROM m) k JOIN bn USING (s, n, w)),
{_side('s', 'ls', 'j', fewest)},
mt AS (SELECT DISTINCT sd.m, sd.s, mi, si FROM sd JOIN m ON m.m = sd.m AND m.s = sd.s AND m.i = sd.i JOIN s ON s.m = sd.m AND s.s = sd.s AND s.j = sd.j),
nd AS (SELECT m.m, m.s, m.mi, s.si, i, j, m.n, m.w FROM m JOIN s ON m.m = s.m AND m.s = s.s AND m.w = s.w AND m.n = s.n JOIN mt ON mt.m = m.m AND mt.s = m.s AND mt.mi = m.mi AND mt.si = s.si)"""


PLAIN = f"""{D}, {B}, {DT}, {BT}, ga AS ({gram_sql(3, 'd', 'm', 'i')}), gb AS ({gram_sql(3, 'b', 's', 'j')}),
dn AS (SELECT dt.m, dt.i, 1 AS n, dt.w, g FROM dt LEFT JOIN ga ON ga.m = dt.m AND ga.i = dt.i), bn AS (SELECT bt.s, bt.j, 1 AS n, bt.w, g FROM bt LEFT JOIN gb ON gb.s = bt.s AND gb.j = bt.j)"""


def _cited_text(table_: str, key: str) -> str:
    text = "text"
    for pattern, mark in CITED:
        text = f"regexp_replace({text}, '{pattern}', '\\1 {mark} ', 'g')"
    return f"SELECT {key}, regexp_extract_all({FOLD.replace('text', text)}, '{W}') AS w FROM {table_}"


def _cited_side(x: str, table_: str, key: str, k: str, at: str) -> str:
    """Units: a name with the year behind it is one of two words; of the others, three in a row start a gram."""
    return f"""{x}0 AS ({_cited_text(table_, key)}), {x}1 AS (SELECT {key} AS {k}, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS {at} FROM {x}0),
{x}2 AS (SELECT *, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lag(w) OVER o AS w0 FROM {x}1 WINDOW o AS (PARTITION BY {k} ORDER BY {at})),
{x}3 AS (SELECT *, (w = 'stone' AND w2 = '2004') OR (w = 'reed' AND w2 = '1999') AS u, coalesce((w0 = 'stone' AND w = '2004') OR (w0 = 'reed' AND w = '1999'), false) AS v FROM {x}2),
{x}n AS (SELECT {k}, {at}, CASE WHEN u THEN 2 ELSE 1 END AS n, CASE WHEN u THEN w || ' ' || w2 ELSE w END AS w,
  CASE WHEN NOT u AND w3 IS NOT NULL AND w2 NOT IN ('stone', 'reed') AND w3 NOT IN ('stone', 'reed') THEN w || ' ' || w2 || ' ' || w3 END AS g FROM {x}3 WHERE NOT v)"""


CITED_UNITS = f"{_cited_side('d', 'documents', 'doc_id', 'm', 'i')}, {_cited_side('b', 'benchmark', 'item_id', 's', 'j')}"

QUERIES = {
    "pair_graph_nodes": (pair_graph_nodes, f"WITH {_graph(PLAIN, 9)} SELECT m, s, mi, si, i, j FROM nd"),
    "pair_graph_edges": (pair_graph_edges, f"""WITH {_graph(PLAIN, 9)}
SELECT x.m, x.s, x.i, x.j, y.i AS yi, y.j AS yj FROM nd x JOIN nd y ON x.m = y.m AND x.s = y.s AND x.mi = y.mi AND x.si = y.si AND y.i - x.i BETWEEN 1 AND 6 AND y.j - x.j BETWEEN 1 AND 6
WHERE NOT EXISTS (SELECT 1 FROM nd z WHERE z.m = x.m AND z.s = x.s AND z.mi = x.mi AND z.si = x.si AND z.i > x.i AND z.j > x.j AND z.i < y.i AND z.j < y.j)"""),
    "citation_units": (citation_units, f"WITH {CITED_UNITS} SELECT m AS doc_id, i, n, w FROM dn WHERE n = 2"),
    "cited_pair_nodes": (cited_pair_nodes, f"WITH {_graph(CITED_UNITS, 4)} SELECT m, s, i, j, n, n = 2 AS unit FROM nd"),
    "cited_graph_matches": (cited_graph_matches, None),
}
