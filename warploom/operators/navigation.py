"""Session-based navigation: a pure reducer from (state, action) to (state, observation).

The same reducer replays recorded actions in a batch and runs behind a stream. A session sees sentences, selects some as
evidence, looks entities up, and stops by an answer. What retrieval finds is data: tables of the first sentences of a
session and of the sentences an entity leads to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import COUNTERS
from .trajectory import parse_action

MENU_AFTER_SELECT, MENU_OTHER = 8, 4


@dataclass
class Episode:
    """State of a session; all of it is lists and dicts of strings and ints, so it can be kept as JSON."""

    begun: bool = False
    stopped: bool = False
    visible: list[str] = field(default_factory=list)
    selected: list[str] = field(default_factory=list)
    looked_up: list[str] = field(default_factory=list)
    lookups: list[list[str]] = field(default_factory=list)
    seen: list[str] = field(default_factory=list)
    menu: dict[str, list] = field(default_factory=dict)
    shown: dict[str, str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)


@dataclass
class World:
    """What a session can find: its first sentences, entities of sentences, sentences of entities, texts, and entities barred from lookup."""

    first: list[str]
    entities: dict[str, list[str]]
    sentences: dict[str, list[str]]
    text: dict[str, str] = field(default_factory=dict)
    barred: frozenset = frozenset()


def _add(ids: list[str], more: list[str]) -> list[str]:
    return list(dict.fromkeys([*ids, *more]))


def _count(s: Episode, name: str, n: int = 1) -> None:
    s.counts[name] = s.counts.get(name, 0) + n


def build_menu(s: Episode, w: World, targets: list[str], most: int, may_answer: bool) -> None:
    """SELECT and ANSWER_WITH for each visible sentence not yet selected, lookups of new targets, ANSWER last; ids A0, A1, ..."""
    open_ = [x for x in s.visible if x not in s.selected]
    for x in _add(s.seen, s.visible):
        s.shown.setdefault(x, f"S{len(s.shown)}")
    rows = [["SELECT", x] for x in open_] + [["ANSWER_WITH", x] for x in open_]
    rows += [["LOOKUP", e] for e in [t for t in dict.fromkeys(targets) if t not in s.looked_up and t not in w.barred][:most]]
    if may_answer:
        rows.append(["ANSWER", ""])
    s.menu = {f"A{k}": r for k, r in enumerate(rows)}
    s.seen = _add(s.seen, s.visible)


def step(s: Episode, action: str, w: World) -> dict:
    """One action: changes s and returns {event, valid, new}. A stopped session answers with ANSWER and changes nothing."""
    if s.stopped:
        return {"event": "ANSWER", "valid": True, "new": []}
    _count(s, "available_action_count", len(s.menu))
    for kind, name in (("ANSWER", "stop"), ("LOOKUP", "lookup"), ("ANSWER_WITH", "answer_with")):
        _count(s, f"{name}_action_available_count", sum(m[0] == kind for m in s.menu.values()))
    a = parse_action(action, {k: v[0] for k, v in s.menu.items()}, s.begun)
    if not a["valid"]:
        _count(s, "invalid_action_count")
        _count(s, "natural_query_count", int(a["natural"]))
        return {"event": "INVALID", "valid": False, "new": []}
    _count(s, "valid_action_id_count")
    _count(s, "step_count")
    kind, target = a["action"], (s.menu.get(a["action_id"]) or ["", ""])[1]
    new: list[str] = []
    if kind == "INIT":
        s.begun = True
        new = [x for x in dict.fromkeys(w.first) if x not in s.seen]
        s.visible = list(dict.fromkeys(w.first))
        build_menu(s, w, [e for x in s.visible for e in w.entities.get(x, [])], MENU_OTHER, False)
    elif kind == "SELECT":
        _count(s, "select_count")
        s.selected = _add(s.selected, [target])
        build_menu(s, w, [e for x in s.selected for e in w.entities.get(x, [])], MENU_AFTER_SELECT, True)
    elif kind == "LOOKUP":
        _count(s, "lookup_count")
        key = [target, ",".join(s.selected)]
        _count(s, "duplicate_lookup_count", int(key in s.lookups))
        _count(s, "bad_target_lookup_count", int(target in w.barred))
        s.lookups.append(key)
        s.looked_up = _add(s.looked_up, [target])
        got = w.sentences.get(target, [])
        new = [x for x in dict.fromkeys(got) if x not in s.seen]
        _count(s, "lookup_new_sid_count", int(bool(new)))
        _count(s, "lookup_success_count", int(bool(new)))
        s.visible = _add(got, s.visible)
        build_menu(s, w, [e for x in s.visible for e in w.entities.get(x, [])], MENU_OTHER, True)
    elif kind == "ANSWER_WITH":
        for c in ("answer_with_count", "select_count", "stop_count"):
            _count(s, c)
        s.selected, s.stopped, s.menu = _add(s.selected, [target]), True, {}
    elif kind == "ANSWER":
        _count(s, "stop_count")
        _count(s, "answer_count")
        s.stopped, s.menu = True, {}
    s.counts["selected_sentence_count"] = len(s.selected)
    return {"event": kind, "valid": True, "new": new}


def observation(s: Episode, out: dict, w: World, marker: str = "OBS") -> str:
    """What the agent is shown: event, new sentences, evidence and menu."""
    line = lambda x: f"{s.shown.get(x, x)} | {w.text.get(x, '')}".rstrip(" |")
    rows = [f"event: {out['event']}"]
    if out["event"] == "INIT":
        rows += ["visible_sentences:", *map(line, s.visible)]
    elif out["event"] == "LOOKUP":
        rows += ["new_visible_sentences:", *map(line, out["new"])]
    if s.selected:
        rows += ["selected_evidence:" if s.stopped else "selected:", *map(line, s.selected)]
    if s.menu:
        rows += ["available_actions:", *(f"{k} = {m[0]} {s.shown.get(m[1], m[1])}".rstrip() for k, m in s.menu.items())]
    return "\n".join([f"[{marker}]", *rows, f"[/{marker}]"])


def preview(s: Episode, action: str, w: World) -> dict:
    """What an action would give, without taking it."""
    import copy

    return step(copy.deepcopy(s), action, w)


def play(actions: list[str], w: World) -> tuple[Episode, list[dict]]:
    s = Episode()
    return s, [step(s, a, w) for a in actions]


def replay(actions: DataFrame, world: DataFrame) -> DataFrame:
    """(session, counters): recorded actions(session, turn, action) replayed against world(session, first, entities, sentences).

    A session's actions are one row's array; sessions are spread over tasks, none is collected. Sessions without a world
    see nothing. ``entities`` and ``sentences`` are maps of id to id arrays.
    """
    a = actions.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "action"))), lambda x: x["action"]).alias("actions"))
    d = a.join(world, "session", "left").select("session", "actions", F.coalesce("first", F.array().cast("array<string>")).alias("first"), F.to_json("entities").alias("e"), F.to_json("sentences").alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            rows = []
            for sid, acts, first, e, s in zip(b["session"], b["actions"], b["first"], b["e"], b["s"]):
                load = lambda x: json.loads(x) if isinstance(x, str) else {}
                state, _ = play([x or "" for x in acts], World(list(first), load(e), load(s)))
                rows.append([sid, *(state.counts.get(c, 0) for c in COUNTERS)])
            yield pd.DataFrame(rows, columns=["session", *COUNTERS])

    return d.mapInPandas(run, "session " + dict(actions.dtypes)["session"] + ", " + ", ".join(f"{c} int" for c in COUNTERS))


# --- the parts of a session that are plain relational ---


def menu_rows(visible: DataFrame, selected: DataFrame, targets: DataFrame, looked_up: DataFrame, most: int = MENU_OTHER) -> DataFrame:
    """(session, action_id, type, target): the menu of every session in one plan; the Column twin of build_menu.

    visible(session, ord, sid), selected(session, sid), targets(session, ord, eid), looked_up(session, eid).
    """
    from pyspark.sql import Window

    w = Window.partitionBy("session")
    open_ = visible.join(selected.select("session", "sid"), ["session", "sid"], "left_anti").select("session", "ord", F.col("sid").alias("target"))
    t = targets.groupBy("session", "eid").agg(F.min("ord").alias("ord")).join(looked_up.select("session", "eid"), ["session", "eid"], "left_anti")
    t = t.withColumn("r", F.row_number().over(w.orderBy("ord", "eid"))).where(F.col("r") <= most).select("session", "ord", F.col("eid").alias("target"))
    rows = open_.select("*", F.lit("SELECT").alias("type"), F.lit(0).alias("p")).unionByName(open_.select("*", F.lit("ANSWER_WITH").alias("type"), F.lit(1).alias("p"))).unionByName(t.select("*", F.lit("LOOKUP").alias("type"), F.lit(2).alias("p")))
    end = visible.select("session").distinct().select("session", F.lit(0).cast(dict(visible.dtypes)["ord"]).alias("ord"), F.lit("").alias("target"), F.lit("ANSWER").alias("type"), F.lit(3).alias("p"))
    k = F.row_number().over(w.orderBy("p", "ord", "target")) - 1
    return rows.unionByName(end).select("session", F.concat(F.lit("A"), k).alias("action_id"), "type", "target")


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order: one-shot events and display ids."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def lookup_specs(df: DataFrame) -> DataFrame:
    """(session, eid, ord, anchor, low_priority): repeated lookup offers as one: first place, first anchor, low only if all are."""
    first = F.min_by("anchor", F.when(F.col("anchor").isNotNull(), F.col("ord")))
    return df.groupBy("session", "eid").agg(F.min("ord").alias("ord"), first.alias("anchor"), F.bool_and("low_priority").alias("low_priority"))


def running_sets(df: DataFrame, part: str, order: str, value: str) -> Column:
    """Ids met up to and with each row, in the order met."""
    from pyspark.sql import Window

    return F.array_distinct(F.flatten(F.collect_list(value).over(Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))))
