"""Payload texts are cleaned in one pass over their bytes, before they meet anything."""

from __future__ import annotations

import inspect
import re

from quarrylight.functions import text as T
from quarrylight.sources.corpus import Corpus

TEXTS = ["", "Plain 1. text", None, "a,b;c\t\n\r\x00\x7fd", "é ü ß 漢字   ﻿", "\U0001f600x\U00010348", "é" * 3, "z" * 70_000 + "–" * 70_000]


def test_every_other_character_is_one_blank(spark):
    rows = [*enumerate(TEXTS), (2, "again!")]
    found = T.plain_texts(spark.createDataFrame(rows, "id long, text string").repartition(3)).collect()
    wanted = [(i, t if t is None else re.sub("[^A-Za-z0-9 .]", " ", t)) for i, t in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(wanted, key=repr)


def test_payloads_have_no_pattern_on_whole_texts(corpus):
    build = inspect.unwrap(Corpus.__dict__["payloads"].func)
    assert "regexp_replace" not in build(corpus)._jdf.queryExecution().executedPlan().toString()
