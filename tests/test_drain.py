"""Mined templates: groups that agree in too little are split, place by place."""
import collections
import random

import pytest

from blocklens.operators import templates as tpl


def brute(masks, share=tpl.SHARE_THRESHOLD, words_per_mask=tpl.WORDS_PER_MASK):
    """mask -> template, by the definition, over distinct masks."""
    def split(group):
        n = len(group[0])
        words = [len({t[i] for t in group}) for i in range(n)]
        open_places = [(w, i) for i, w in enumerate(words) if w > 1]
        if open_places and words.count(1) < share * n and min(open_places)[0] <= words_per_mask * len(group):
            place = min(open_places)[1]
            for word in {t[place] for t in group}:
                yield from split([t for t in group if t[place] == word])
        else:
            template = " ".join(group[0][i] if w == 1 else "<*>" for i, w in enumerate(words))
            yield from ((" ".join(t), template) for t in group)

    groups = collections.defaultdict(list)
    for m in set(masks):
        toks = m.split(" ") if m else []
        first = toks[0] if toks else ""
        groups[len(toks), "<*>" if any(c.isdigit() for c in first) else first].append(toks)
    return dict(pair for own in groups.values() for pair in split(own))


def frame(spark, masks):
    return spark.createDataFrame(list(enumerate(masks, start=1)), "line_id long, template string")


@pytest.mark.parametrize("share,words", [(0.4, 0.5), (0.7, 0.9), (0.4, 0.05)])
def test_matches_definition(spark, share, words):
    rng = random.Random(3)
    masks = [" ".join(rng.choice(["open", "close", f"v{rng.randint(0, 40)}", "<NUM>"])
                      for _ in range(rng.randint(1, 5))) for _ in range(300)] + ["", "", "solo"]
    mined = tpl.mined_masks(frame(spark, masks), share, words).collect()
    assert {r.template: r.event_template for r in mined} == brute(masks, share, words)
    count = collections.Counter(masks)
    assert {r.template: r.occurrences for r in mined} == count


def test_rare_kinds_of_lines_keep_their_templates(spark):
    """Two rare kinds of line beside a frequent one with the same length and first word."""
    masks = [f"block n{i} moved to host{i % 50} by user{i}" for i in range(200)]
    masks += [f"block n{i} was not found on host{i}" for i in range(3)]
    masks += [f"block n{i} has been lost since boot{i}" for i in range(2)]
    mined = {r.template: r.event_template for r in tpl.mined_masks(frame(spark, masks)).collect()}
    assert collections.Counter(mined.values()) == {
        "block <*> moved to <*> by <*>": 200, "block <*> was not found on <*>": 3,
        "block <*> has been lost since <*>": 2}


def test_known_merge_of_the_published_run(spark):
    """Lines that agree in most places are one template, whatever their last word."""
    masks = ["PacketResponder <NUM> for block <BLOCK_ID> terminating",
             "PacketResponder <NUM> for block <BLOCK_ID> Interrupted.",
             "Receiving block <BLOCK_ID> src: <IP> dest: <IP>", "Deleting block <BLOCK_ID> file <*>",
             "Verification succeeded for <BLOCK_ID>"]
    mined = {r.template: r.event_template for r in tpl.mined_masks(frame(spark, masks)).collect()}
    assert set(mined.values()) == {"PacketResponder <NUM> for block <BLOCK_ID> <*>", *masks[2:]}


def test_values_of_a_variable_are_no_templates(spark):
    masks = [f"login user {u} ok" for u in ("ann", "bob", "cid")] * 5
    mined = tpl.mined_masks(frame(spark, masks)).collect()
    assert {r.event_template for r in mined} == {"login user <*> ok"}


def test_ids_follow_first_appearance_and_cover_every_line(spark):
    masks = ["b x 1", "a y", "b x 2", "b x 3", "a y", "", "c"]
    mined = tpl.mined_masks(frame(spark, masks))
    templates, mapping = tpl.mined_from_masks(mined)
    got = {r.event_template: (r.event_id, r.occurrences, r.first_line_id) for r in templates.collect()}
    assert got == {"b x <*>": (1, 3, 1), "a y": (2, 2, 2), "": (3, 1, 6), "c": (4, 1, 7)}
    lines = tpl.assign_events(frame(spark, masks), mapping)
    assert lines.count() == len(masks)


def test_many_first_tokens_change_nothing(spark):
    """No limit on the number of groups: 500 first words keep their own templates."""
    masks = [f"{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxy'[i // 100]} one two" for i in range(500)]
    mined = tpl.mined_masks(frame(spark, masks)).collect()
    assert all(r.template == r.event_template for r in mined) and len(mined) == 500


@pytest.mark.parametrize("together", [0, 7])
def test_groups_of_any_size_are_judged_alike(spark, together):
    """Groups beyond ``together`` masks are counted place by place, smaller ones in a row."""
    rng = random.Random(5)
    masks = [" ".join(rng.choice(["open", "close", f"v{rng.randint(0, 9)}", "<*>"])
                      for _ in range(rng.randint(1, 5))) for _ in range(200)] + ["", "solo"]
    mined = tpl.mined_masks(frame(spark, masks), together=together).collect()
    assert {r.template: r.event_template for r in mined} == brute(masks)


def test_levels_leave_one_copy_of_the_masks(spark):
    """The table of a level goes when the next one stands, and every mask that settles
    is written once."""
    import glob

    from blocklens.session import ensure_checkpoint_dir
    root = ensure_checkpoint_dir(spark).removeprefix("file:") + "/scratch/"
    before = set(glob.glob(root + "*"))
    masks = [f"{a} {b} {c} {i}x {i}y {i}z" for i, (a, b, c) in enumerate(
        (a, b, c) for _ in range(8) for a in "kl" for b in "mn" for c in "op")]
    mined = tpl.mined_masks(frame(spark, masks), 0.9).collect()
    assert {r.template: r.event_template for r in mined} == brute(masks, 0.9)
    left = [p[len(root):].rsplit("-", 1)[0] for p in set(glob.glob(root + "*")) - before]
    assert left.count("mask-splits") > 2 and left.count("mask-groups") == 1
    kept = [p for p in set(glob.glob(root + "*")) - before if "mask-clusters" in p or "mask-groups" in p]
    assert sum(spark.read.schema("template string").parquet(p).count() for p in kept) == len(set(masks))
