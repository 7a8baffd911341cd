import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(autouse=True)
def llm_settings(spark):
    from inkveil.llm.common import apply_settings

    apply_settings(spark)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text, width=5):
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


class Groups:
    """Union by smallest member."""

    def __init__(self, items):
        self.of = {i: i for i in items}

    def find(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)
