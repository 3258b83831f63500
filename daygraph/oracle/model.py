"""SQL on fits: what they were given; the flags must be true."""

from daygraph.oracle.base import big, sql
from daygraph.oracle.evaluate import EVAL

_SIZES = ", ".join(f"{big(f'''count(*) FILTER (split = '{s}')''')} AS n_{s}" for s in ("train", "dev", "test"))
_HITS = ", ".join(f"{big(f'''count(*) FILTER (split = '{s}' AND connected)''')} AS {s}_positives" for s in ("train", "dev", "test"))
_HELD = ", ".join(f"{big(f'''count(*) FILTER (split = '{s}')''')} AS {s}_positives" for s in ("train", "dev", "test"))


def _arms(names: str) -> str:
    return sql(f"SELECT arm, TRUE AS converged, TRUE AS beats_floor, s.* FROM (VALUES {names}) a(arm), (SELECT {_SIZES}, {_HITS} FROM rex) s", **EVAL)


ORACLE = {
    "node_classifier": sql(f"""SELECT l.*, s.*, TRUE AS converged, TRUE AS beats_floor
        FROM (SELECT concept_id, {_HELD} FROM lab WHERE concept_id IN (SELECT concept_id FROM idx) GROUP BY 1) l, (SELECT {_SIZES} FROM ks) s""", **EVAL),
    "edge_classifier": _arms("('full')"),
    "edge_ablations": _arms("('pair_only'), ('type_pol_only')"),
}
