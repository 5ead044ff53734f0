"""Paragraph dedup does the whole job: unique text stays, repeats go."""
import random

from blocklens.llm import paragraph_dedup as pd_


def words(rng, n):
    return ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(n)]


def dedup(make_docs, rows):
    return {r.doc_id: r for r in pd_.paragraph_dedup(make_docs(rows), with_text=True).collect()}


def test_a_unique_sentence_before_a_newline_is_no_repeat_of_itself(make_docs):
    rng = random.Random(1)
    rows = [(1, " ".join(words(rng, 30)) + ".\n" + " ".join(words(rng, 30)) + ".\n"),
            (2, " ".join(words(rng, 40)) + ".\nShort tail here.")]
    got = dedup(make_docs, rows)
    assert all(got[i].n_removed == 0 and got[i].n_repeated == 0 for i in (1, 2))
    assert got[1].n_paragraphs == 2


def test_a_line_is_no_repeat_of_the_sentence_in_it(make_docs):
    rng = random.Random(2)
    line = " ".join(words(rng, 40)) + ". Yes."
    rows = [(1, line + "\nfirst " + " ".join(words(rng, 9))), (2, " ".join(words(rng, 9)) + ".\n" + line),
            (3, " ".join(words(rng, 50)) + ". No.\n" + " ".join(words(rng, 9)))]
    got = dedup(make_docs, rows)
    assert got[1].n_removed == got[3].n_removed == 0 and got[3].n_repeated == 0
    assert got[2].n_removed >= len(line) - 5


def test_a_passage_of_short_pieces_goes(make_docs):
    """Also inside other text, at another offset; the first one stays."""
    rng = random.Random(3)
    pieces = [" ".join(words(rng, 1 + i % 3)) + "!!" for i in range(40)]
    own = [" ".join(w + "!!" for w in words(rng, 20)) for _ in range(4)]
    rows = [(1, " ".join([own[0], *pieces, own[1]])), (2, " ".join([own[2], *pieces, own[3]]))]
    got = dedup(make_docs, rows)
    assert got[1].n_removed == 0
    assert got[2].n_removed >= 0.9 * len(" ".join(pieces))
    assert own[2] in got[2].kept and own[3] in got[2].kept


def test_unique_short_pieces_between_repeats_stay():
    rng = random.Random(4)
    repeat = " ".join(words(rng, 30)) + "."
    unique = " ".join(w + "!" for w in words(rng, 40))
    own = pd_.Paragraphs(f"{repeat} {unique} {repeat}")
    again = [u for u, x in enumerate(own.units) if x[4] == "sentence"]
    assert [own.size - sum(b - a for a, b in pd_.removed_spans(own, again))] == [len(unique) + 1]


def test_a_near_copy_of_a_short_text_goes(make_docs):
    rng = random.Random(5)
    text = words(rng, 24)
    got = dedup(make_docs, [(1, " ".join(text) + "."), (2, " ".join(text[:-1] + ["other"]) + ".")])
    assert got[1].n_removed == 0 and got[2].kept == ""


def test_lines_and_sentences_have_a_family_of_keys_in_common():
    """A near copy meets whether it is a whole line or a sentence in one."""
    rng, hits = random.Random(6), 0
    for _ in range(100):
        text = words(rng, 32)
        line = pd_.Paragraphs(" ".join(text))
        inside = pd_.Paragraphs(" ".join(words(rng, 20)) + ". " + " ".join(text[:-1] + ["other"]) + ". Yes.")
        inside.units = [u for u in inside.units if u[:2] == (1, 1)]
        a, b = pd_.band_keys([line])[0], pd_.band_keys([inside])[0]
        hits += bool(set(a.tolist()) & set(b.tolist()))
    assert hits >= 95


def test_a_near_copy_of_a_line_inside_another_line_goes(make_docs):
    rng = random.Random(7)
    rows = []
    for i in range(6):
        text = words(rng, 40)
        rows += [(i, " ".join(text)),
                 (100 + i, " ".join(words(rng, 12)) + ". " + " ".join(text[:-1] + ["other"]) + ". "
                  + " ".join(words(rng, 12)) + ".")]
    got = dedup(make_docs, rows)
    assert all(got[i].n_removed == 0 and got[100 + i].n_removed > 250 for i in range(6))
