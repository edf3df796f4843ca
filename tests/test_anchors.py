import pytest
from conftest import SF_SMALL

from tickpulse.sources import fixtures as fx


@pytest.mark.parametrize("build, rows", [(fx.fb_post, "turn = 0"), (fx.zalo_chat, "true"), (fx.youtuber_advice, "role = 'assistant'"), (fx.rumors, "role = 'user'")])
def test_conversations_beyond_the_last_event_keep_their_rows(spark, build, rows):
    time = {"fb_post": "timestamp", "zalo_chat": "date"}.get(build.__name__, "timestamp")
    got = build(spark, SF_SMALL)
    assert got.count() == fx.table(spark, SF_SMALL, "conversations").where(rows).count()
    assert got.where(got[time].isNull()).count() == 0
