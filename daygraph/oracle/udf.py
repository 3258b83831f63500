"""SQL for the queries on user-supplied functions."""

from daygraph.oracle.base import r6, sql
from daygraph.oracle.evaluate import EVAL, curve
from daygraph.oracle.prepare import hexnum

ORACLE = {
    "udf_scorer": sql("""SELECT t.sample_id, c.concept_id, ((length(t.text) * (7919 + 13 * c.number) + 104729 * c.number) % 1000)::DOUBLE / 1000 AS score
        FROM texts t, (SELECT concept_id, row_number() OVER (ORDER BY concept_id) - 1 AS number FROM concepts) c"""),
    "udf_feature_fn": sql("""SELECT x.example_id, unnest(['type_a=' || a.type, 'type_b=' || b.type, 'same=' || CASE WHEN a.polarity = b.polarity THEN 'True' ELSE 'False' END]) AS feature, unnest([1.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE]) AS value
        FROM rex x JOIN nodes a ON a.sample_id = x.sample_id AND a.node_id = x.node_a JOIN nodes b ON b.sample_id = x.sample_id AND b.node_id = x.node_b""", **EVAL),
    "udaf_select_fn": sql(f"SELECT concept_id, {r6('t')} AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY f1 DESC, t) AS r FROM each) WHERE r = 1",
        **EVAL, each=curve("SELECT concept_id, gold, score FROM lscore WHERE split = 'dev'", "concept_id")),
    "udtf_pairs": sql("""SELECT a.sample_id, least(a.type, b.type) AS type_a, greatest(a.type, b.type) AS type_b, count(*) AS n_pairs FROM nodes a JOIN nodes b
        ON a.sample_id = b.sample_id AND a.pos < b.pos GROUP BY 1, 2, 3"""),
}
