"""The four searches as SQL table functions over a view of chunks.

``register`` names a view and the functions ``exact_search``, ``text_search``,
``hybrid_search`` and ``latest_sessions``, so that SQL users call them like tables:

    SELECT * FROM hybrid_search(:vector, :words, 10, :project)

Arguments are values: bound ones never become part of the statement's text. Filters are
absent where null. Results equal those of ``Engine``'s operators; ties go by id. A limit is
an argument, so Spark can't plan it as one: rows are ranked in ``PARTS`` parts by id first,
and only the best of each part meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.hybrid import CANDIDATES, RRF_K
from ..operators.text import K1, SPLIT, B

VIEW = "chunks"
_TOKENS = "filter(split(lower(coalesce({}, '')), '{}'), t -> t <> '')"
_FILTER = "(project IS NULL OR ProjectPath = project) AND (kind IS NULL OR ChunkType = kind)"
PARTS = 256
_TOP = f"""SELECT {{columns}} FROM (SELECT *, row_number() OVER (ORDER BY {{order}}) AS whole_place FROM (
  SELECT *, row_number() OVER (PARTITION BY pmod(xxhash64(Id), {PARTS}) ORDER BY {{order}}) AS part_place FROM ({{rows}})) WHERE part_place <= most) WHERE whole_place <= most"""


def _functions(view: str) -> list[str]:
    norm = "sqrt(aggregate({}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))".format
    dot = "aggregate(zip_with(Vector, near, (a, b) -> CAST(a AS DOUBLE) * CAST(b AS DOUBLE)), 0D, (s, x) -> s + x)"
    distance = f"1 - {dot} / ({norm('Vector')} * {norm('near')})"
    exact = _TOP.format(columns="Id, Distance", order="Distance, Id", rows=f"SELECT Id, {distance} AS Distance FROM {view} WHERE Vector IS NOT NULL AND {_FILTER}")
    own, asked = (_TOKENS.format(x, SPLIT.replace("\\", "\\\\")) for x in ("Content", "words"))
    counted = f"SELECT Id, ProjectPath, ChunkType, size({own}) AS dl, transform(array_distinct({asked}), w -> size(filter({own}, t -> t = w))) AS tf FROM {view}"
    postings = f"SELECT Id, ProjectPath, ChunkType, dl, size(tf) AS many, place, f FROM ({counted}) LATERAL VIEW posexplode(tf) p AS place, f WHERE f > 0"
    weight = f"ln(1 + (n - df + 0.5D) / (df + 0.5D)) * f * {K1 + 1}D / (f + {K1}D * ({1 - B}D + {B}D * dl / avgdl))"
    scored = f"""SELECT Id, sum({weight}) AS Score FROM (SELECT *, count(*) OVER (PARTITION BY place) AS df FROM ({postings})) CROSS JOIN (SELECT count(*) AS n, avg(size({own})) AS avgdl FROM {view})
      WHERE {_FILTER} GROUP BY Id HAVING count(*) = max(many)"""
    said = _TOP.format(columns="Id, Score", order="Score DESC, Id", rows=scored)
    ranked = "SELECT Id, row_number() OVER (ORDER BY {}) AS rank FROM {}".format
    both = f"{ranked('Distance, Id', f'exact_search(near, {CANDIDATES}, project, kind)')} UNION ALL {ranked('Score DESC, Id', f'text_search(words, {CANDIDATES}, project, kind)')}"
    fused = f"SELECT Id, sum(1D / ({RRF_K} + rank)) AS Score FROM ({both}) GROUP BY Id"
    hybrid = _TOP.format(columns=f"Id, 1 - least(1D, Score / (2D / ({RRF_K} + 1))) AS Distance", order="Score DESC, Id", rows=fused)
    latest = f"SELECT SessionId, min_by(Id, struct(-unix_micros(Timestamp), Id)) AS Id, max(Timestamp) AS Timestamp FROM {view} WHERE {_FILTER} GROUP BY SessionId"
    sessions = _TOP.format(columns="SessionId, Id, Timestamp", order="Timestamp DESC, Id", rows=latest)
    wanted = "most INT, project STRING DEFAULT NULL, kind STRING DEFAULT NULL"
    return [
        f"FUNCTION exact_search(near ARRAY<DOUBLE>, {wanted}) RETURNS TABLE (Id STRING, Distance DOUBLE) RETURN {exact}",
        f"FUNCTION text_search(words STRING, {wanted}) RETURNS TABLE (Id STRING, Score DOUBLE) RETURN {said}",
        f"FUNCTION hybrid_search(near ARRAY<DOUBLE>, words STRING, {wanted}) RETURNS TABLE (Id STRING, Distance DOUBLE) RETURN {hybrid}",
        f"FUNCTION latest_sessions({wanted}) RETURNS TABLE (SessionId STRING, Id STRING, Timestamp TIMESTAMP) RETURN {sessions}",
    ]


def register(chunks: DataFrame, view: str = VIEW) -> None:
    """Make ``chunks`` a view of its session, and the functions over it; again replaces them."""
    chunks.createOrReplaceTempView(view)
    for text in _functions(view):
        chunks.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY {text}")
