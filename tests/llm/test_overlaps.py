"""Decontamination against every diagonal, without seeds."""

import itertools
import math
import random

import pytest
from glossmill.llm import decontamination


def need(width):
    return math.ceil(0.8 * width - 1e-9)


@pytest.mark.parametrize("width", range(10, 21))
def test_masks_hit_every_accepted_pattern(width):
    marks = [sum(1 << k << at for k, m in enumerate(mask) if m == "1") for mask in decontamination.MASKS for at in range(width - len(mask) + 1)]
    for wrong in itertools.combinations(range(width), width - need(width)):
        bits = sum(1 << k for k in wrong)
        assert any(m & bits == 0 for m in marks), wrong


@pytest.mark.parametrize("width", range(5, 10))
def test_short_masks_hit_every_item_with_one_word_changed(width):
    assert width - need(width) == 1
    marks = [sum(1 << k << at for k, m in enumerate(mask) if m == "1") for mask in decontamination.SHORT_MASKS for at in range(width - len(mask) + 1)]
    for wrong in range(width):
        assert any(m & 1 << wrong == 0 for m in marks), wrong


def best(t, item):
    """Most agreeing places in a stretch, over all diagonals."""
    width, found = min(20, len(item)), 0
    for s in range(-len(item) + 1, len(t)):
        same = [0 <= i + s < len(t) and t[i + s] == w for i, w in enumerate(item)]
        found = max(found, *(sum(same[i : i + width]) for i in range(len(same) - width + 1)))
    return found


@pytest.mark.parametrize("diagonals", [1000, 3])
def test_overlaps_against_every_diagonal(spark, monkeypatch, diagonals):
    monkeypatch.setattr(decontamination, "DIAGONALS", diagonals)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in [*range(10, 22), 40, 100]]
    docs = [[w if k % 5 else word() for k, w in enumerate(x)] for x in items]
    for item in items:
        for _ in range(12):
            copy, width = list(item), min(20, len(item))
            for k in rng.sample(range(width), width - need(width) + rng.randint(0, 1)):
                copy[k] = word()
            for k in range(20, len(item)):
                copy[k] = word()
            docs.append([word() for _ in range(rng.randint(0, 4))] + copy)
        docs += [item[: need(min(20, len(item)))], item[-need(min(20, len(item))) :]]
    want = {(d, k): m for d, t in enumerate(docs) for k, x in enumerate(items) if (m := best(t, x)) >= need(min(20, len(x)))}
    table = lambda rows, key: spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], f"{key} long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.overlaps(table(docs, "doc_id"), table(items, "item_id")).collect()}
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("share", [0.8, 1.0])
def test_short_items_against_every_diagonal(spark, share):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in [*range(5, 12), 9, 7]]
    docs = []
    for item in items:
        for k in range(len(item)):
            for extra in (0, 1):
                copy = list(item)
                for at in (k, (k + 2) % len(item))[: 1 + extra]:
                    copy[at] = word()
                docs.append([word() for _ in range(rng.randint(0, 3))] + copy + [word() for _ in range(rng.randint(0, 3))])
        docs += [item, item[1:], item[:-1], item[1:] + [word()] + item]
    enough = lambda n: need(n) if n >= decontamination.SPAN else math.ceil(share * n - 1e-9)
    want = {(d, k): m for d, t in enumerate(docs) for k, x in enumerate(items) if (m := best(t, x)) >= enough(len(x))}
    table = lambda rows, key: spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(rows)], f"{key} long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontamination.overlaps(table(docs, "doc_id"), table(items, "item_id"), share).collect()}
    assert len(want) > 30 and got == want
