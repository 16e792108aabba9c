"""SSE captures: facts must not depend on how the bytes were cut into reads."""

from __future__ import annotations

from gatemeter.operators import sse
from gatemeter.sources import bridges
from gatemeter.sources.tables import read_table

from conftest import SF_SMALL

KEYS = ["conv_id", "turn"]
COLS = ["conv_id", "turn", "text", "message_id", "stop_reason", "completed", "tool_names"]


def test_cut_size_does_not_change_facts(spark):
    conv = read_table(spark, SF_SMALL, "conversations")
    small = sse.facts_from_chunks(bridges.sse_chunks(conv, 7), KEYS)
    large = sse.facts_from_chunks(bridges.sse_chunks(conv, 4096), KEYS)
    whole = sse.facts_from_raw(bridges.sse_raw(conv), KEYS)
    assert small.select(*COLS).exceptAll(whole.select(*COLS)).count() == 0
    assert large.select(*COLS).exceptAll(whole.select(*COLS)).count() == 0
    assert small.count() == whole.count() > 0


def test_text_round_trip(spark):
    """text -> SSE events -> text restores every assistant turn."""
    conv = read_table(spark, SF_SMALL, "conversations")
    facts = sse.facts_from_chunks(bridges.sse_chunks(conv, 7), KEYS)
    got = facts.select(*KEYS, facts["text"].alias("got"))
    want = conv.where("role = 'assistant'").select(*KEYS, conv["text"].alias("want"))
    joined = got.join(want, KEYS)
    assert joined.count() == want.count() > 0
    assert joined.where("got != coalesce(want, '')").count() == 0
