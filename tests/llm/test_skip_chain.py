"""What the skip edges add: tokens that say nothing alone but stand elsewhere in the document beyond doubt."""

import random

import numpy as np
import pytest

from marlstone.llm import pii


@pytest.fixture(scope="module")
def field():
    rnd = random.Random(3)
    train = [f"call +1 ({rnd.randrange(100, 999)}) 555-{1000 + i} now" for i in range(60)]
    train += [f"the part {rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)} is on shelf {i}" for i in range(120)]
    return pii.fit(train)


def without_skip(field):
    return pii.Field(field.own, field.chain, np.zeros_like(field.skip))


def added(text, field):
    (base,), (every,) = pii.spans([text], field)
    assert set(base) == set(pii.patterns(text)) and set(base) <= set(every)
    return {(pii.KINDS[k], text[a:b]) for a, k, b in set(every) - set(base)}


def test_a_number_without_its_area_code(field):
    text = "ring +1 (111) 555-1011 today " + "word " * 80 + "the part 222-3333 is here, again 555-1011 then"
    assert added(text, field) == {("phone", "555-1011")}
    assert added(text, without_skip(field)) == set()


def test_labels_reach_the_last_of_many_repetitions():
    """One occurrence is plain by its own sign, the others lean a little the other way."""
    same = np.full((pii.LABELS, pii.LABELS), -3.0) + 6 * np.eye(pii.LABELS)
    field = pii.Field({"f+": np.array([0, 0, 0, 8.0, 0]), "fx": np.array([0, 0, 0, 0, 0.05])}, np.zeros((pii.LABELS, pii.LABELS)), same)
    text = "ring +15551234567 today " + "then the 15551234567 is read " * 60
    assert len(pii.spans([text], field)[1][0]) == 61
    assert len(pii.spans([text], without_skip(field))[1][0]) == 1


def test_no_card_fails_its_check_sum(field):
    cards = pii.fit([f"pay with 4111 1111 1111 1111 or 4111111111111111 at till {i}" for i in range(40)])
    for text in ("pay with 4111 1111 1111 1112 or 4111111111111112 at till 3", "4111111111111112 " * 5):
        assert not [k for k, _ in added(text, cards) if k == "card"]


def test_nothing_to_learn_from(spark):
    for rows in ([], [(None,)], [("no such thing",)]):
        field = pii.learn(spark.createDataFrame(rows, "text string"))
        assert pii.spans(["call +1 (111) 555-1011, then 555-1011", ""], field)[0][0] == pii.spans(["call +1 (111) 555-1011, then 555-1011", ""], field)[1][0]
