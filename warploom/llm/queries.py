"""The queries of this subpackage by name; pN_ names belong to problem N."""

from __future__ import annotations

from ..session import sound
from . import p1_groups, p2_pairs, p3_splits, p4_names, p5_neighbours, p6_split, p7_pack, p8_leaks, p9_abuse


def queries() -> dict:
    found = {
        "p1_found": p1_groups.found,
        "p1_group_sizes": p1_groups.group_sizes,
        "p2_found": p2_pairs.found,
        "p2_report": p2_pairs.report,
        "p3_found": p3_splits.found,
        "p3_report": p3_splits.report,
        "p4_found": p4_names.found,
        "p4_report": p4_names.report,
        "p5_found": p5_neighbours.found,
        "p5_searched": p5_neighbours.searched,
        "p6_found": p6_split.found,
        "p6_pieces": p6_split.pieces,
        "p6_report": p6_split.report,
        "p7_placement": p7_pack.placement,
        "p7_fill": p7_pack.fill,
        "p7_tokens_placed": p7_pack.tokens_placed,
        "p8_found": p8_leaks.found,
        "p8_report": p8_leaks.report,
        "p9_found": p9_abuse.found,
        "p9_scored": p9_abuse.scored,
        "p9_rates": p9_abuse.rates,
    }
    return {k: sound(v) for k, v in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": p6_split.FOUND_SQL, "p7_tokens_placed": p7_pack.TOKENS_SQL}
