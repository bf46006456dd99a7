"""Chat formatting with minimum-cost role repair.

A chat is legal if it is empty, or an optional system turn followed by turns that alternate
between user and assistant, from user to assistant. Each turn of a conversation is kept, merged
into the turn before, relabelled, or preceded by an empty turn; dynamic programming over the
automaton of legal turns finds the cheapest sequence of such choices. The steps of one turn form
a matrix of costs between states, so a long conversation is cut into blocks whose matrices are
combined in order, and every block is then repaired by itself between its states.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliarc.llm.common import partitions, staged

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
BLOCK_TURNS = 1024
NEVER = 1 << 40


def role_of(name: str | None) -> int:
    """State of a role name, ignoring case and blanks around; 0 for any other."""
    name = (name or "").strip().lower()
    return NAMES.index(name) if name in NAMES else START


@lru_cache(maxsize=None)
def steps(role: int) -> tuple[tuple[int, int, int, str, tuple[int, ...]], ...]:
    """Moves of a turn with this role: (cost, from, to, action, empty turns put before), cheapest and plainest first."""
    found = []
    for state in NEXT:
        for target in (SYSTEM, USER, ASSISTANT):
            change = 0 if target == role else RELABEL if role else UNKNOWN
            label = "keep" if not change else "relabel"
            if state == target:
                found.append((MERGE + change, state, target, "merge" if not change else "merge_relabel", ()))
            if target in NEXT[state]:
                found.append((change, state, target, label, ()))
            else:
                bridge = [p for p in NEXT[state] if target in NEXT[p]]
                found += [(change + INSERT, state, target, label, (p,)) for p in bridge[:1]]
    return tuple(sorted(found, key=lambda m: (m[0], m[1], m[2], m[3])))


def closing(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns that end a chat after ``state``."""
    missing = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]
    return INSERT * len(missing), missing


def matrix(roles: list[int]) -> np.ndarray:
    """Least cost from each state to each state over these turns."""
    cost = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for role in roles:
        new = np.full((4, 4), NEVER)
        for price, before, after, _, _ in steps(role):
            new[:, after] = np.minimum(new[:, after], cost[:, before] + price)
        cost = new
    return cost


def repair(roles: list[int], entry: int, leave: int) -> list[tuple]:
    """The cheapest moves that lead from state ``entry`` to ``leave``; of equal ones the first in order of ``steps``."""
    cost, back = [NEVER] * 4, []
    cost[entry] = 0
    for role in roles:
        new, chosen = [NEVER] * 4, [None] * 4
        for move in steps(role):
            total = cost[move[1]] + move[0]
            if total < new[move[2]]:
                new[move[2]], chosen[move[2]] = total, move
        cost = new
        back.append(chosen)
    moves, state = [], leave
    for chosen in reversed(back):
        moves.append(chosen[state])
        state = chosen[state][1]
    return moves[::-1]


def opened(role: int) -> str:
    return f"<|im_start|>{NAMES[role]}\n"


CLOSED = "<|im_end|>\n"


def plain(text: str | None) -> str:
    """Text whose own marks cannot be read as turn marks."""
    return (text or "").replace("<|im_", "< |im_")


def rendered(move: tuple, text: str | None, first: bool, ending: tuple[int, ...] | None) -> str:
    """This turn's share of the chat: the pieces of a conversation in order are the whole chat."""
    _, before, after, action, put = move
    out = "" if first or action.startswith("merge") else CLOSED
    out += "".join(opened(p) + CLOSED for p in put)
    out += "\n" if action.startswith("merge") else opened(after)
    out += plain(text)
    if ending is not None:
        out += CLOSED + "".join(opened(p) + CLOSED for p in ending)
    return out


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Complete groups of sorted batches, one at a time; nulls are equal."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        marks = batch[keys].fillna(-1).to_numpy()
        edge = np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1)))
        if held and (held[-1][keys].iloc[-1:].fillna(-1).to_numpy()[0] != marks[0]).any():
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        for start, stop in zip(edge[:-1], edge[1:]):
            part = batch.iloc[start:stop]
            yield pd.concat([*held, part], ignore_index=True) if held else part
            held = []
        held.append(batch.iloc[edge[-1]:])
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def block_costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for group in runs(batches, ["conv", "none", "block"]):
        cost = matrix([role_of(r) for r in group["role"]])
        out.append((group["conv"].iat[0], group["none"].iat[0], group["block"].iat[0], len(group), cost.ravel().tolist()))
        if len(out) >= 10_000:
            yield costs_frame(out)
            out = []
    if out:
        yield costs_frame(out)


def costs_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv", "none", "block", "turns", "cost"])


def block_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entry and exit state and first place of every block: forward over the blocks' matrices, then back from the cheapest end."""
    out = []
    for group in runs(batches, ["conv", "none"]):
        costs = [np.asarray(c, np.int64).reshape(4, 4) for c in group["cost"]]
        total, back = np.array([0, NEVER, NEVER, NEVER]), []
        for cost in costs:
            sums = total[:, None] + cost
            back.append(sums.argmin(axis=0))
            total = sums.min(axis=0)
        state = int(np.argmin(total + np.array([closing(s)[0] for s in range(4)])))
        ends = []
        for chosen in reversed(back):
            ends.append((int(chosen[state]), state))
            state = int(chosen[state])
        places = np.cumsum(group["turns"].to_numpy()) - group["turns"].to_numpy()
        for (entry, leave), block, place, i in zip(reversed(ends), group["block"], places, range(len(costs))):
            out.append((group["conv"].iat[0], group["none"].iat[0], block, entry, leave, int(place), i == len(costs) - 1))
        if len(out) >= 10_000:
            yield states_frame(out)
            out = []
    if out:
        yield states_frame(out)


def states_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["conv", "none", "block", "entry", "leave", "place", "last"])


REPAIRED = "conv_id long, place long, turn long, role string, repaired_role string, action string, inserted string, appended string, cost int, rendered string"


def block_repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    out = []
    for group in runs(batches, ["conv", "none", "block"]):
        entry, leave, place, last = (group[c].iat[0] for c in ("entry", "leave", "place", "last"))
        moves = repair([role_of(r) for r in group["role"]], int(entry), int(leave))
        none = bool(group["none"].iat[0])
        for i, (move, turn, role, text) in enumerate(zip(moves, group["turn"], group["role"], group["text"])):
            ending = closing(move[2])[1] if last and i == len(moves) - 1 else None
            put, end = (",".join(NAMES[p] for p in turns) for turns in (move[4], ending or ()))
            out.append((None if none else group["conv"].iat[0], int(place) + i, None if pd.isna(turn) else int(turn), role, NAMES[move[2]], move[3],
                        put, end, move[0] + INSERT * len(ending or ()), rendered(move, text, int(place) + i == 0, ending)))
        if len(out) >= 10_000:
            yield repairs_frame(out)
            out = []
    if out:
        yield repairs_frame(out)


def repairs_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in REPAIRED.split(", ")])
    return frame.astype({"conv_id": "Int64", "turn": "Int64"})


def format_chats(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text), repaired and rendered.

    ``place`` counts a conversation's turns from 0 in order of turn (null last), role and text;
    ``inserted`` names the empty turns put before it and ``appended`` those that end the chat after its
    last turn; the ``rendered`` pieces by place are the chat. Unknown and null roles may become any role;
    null text is empty; turns of a null conv_id are one conversation; repeated rows are turns each.
    Other columns are ignored; an empty table gives an empty result. Texts move once, to their block.
    """
    spark = turns.sparkSession
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none"),
                        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit((1 << 62))).cast("long").alias("block"),
                        F.col("turn").cast("long").alias("turn"), "role", "text")
    block, conv = ["conv", "none", "block"], ["conv", "none"]
    inside = [F.col("turn").asc_nulls_last(), "role"]
    narrow = rows.select(*block, "turn", "role").repartition(partitions(spark), *block).sortWithinPartitions(*block, *inside)
    costs = narrow.mapInPandas(block_costs, "conv long, none boolean, block long, turns long, cost array<long>")
    lined = costs.repartition(partitions(spark), *conv).sortWithinPartitions(*block)
    states = staged(lined.mapInPandas(block_states, "conv long, none boolean, block long, entry int, leave int, place long, last boolean"), "blocks")
    guided = rows.join(states, block)
    return guided.repartition(partitions(spark), *block).sortWithinPartitions(*block, *inside, "text").mapInPandas(block_repairs, REPAIRED)
