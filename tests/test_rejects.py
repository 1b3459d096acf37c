from __future__ import annotations

from ledgerspark.plans import enrichment


def test_every_unused_part_of_a_reply_has_a_reason(spark):
    replies = [
        (1, 'Sure: {"profiles": [{"normalized_merchant": "A", "merchant_summary": "x"}, {"normalized_merchant": " "}, null, {"normalized_merchant": "Z"}]}'),
        (2, "no idea"),
        (3, '{"profiles": [{"normalized_merchant": '),
        (4, '{"profiles": [{"normalized_merchant": }'),
        (5, '{"profiles": []}'),
        (6, '{"other": 1}'),
        (7, None),
    ]
    frame = spark.createDataFrame(replies, "reply_id long, reply string")
    batch = spark.createDataFrame([("A", "g", "c"), ("B", "g", "c")], "normalized_merchant string, merchant_group string, final_category string")
    found = {(r.reply_id, r.place, r.normalized_merchant, r.reason) for r in enrichment.rejected_profiles(frame, batch).collect()}
    assert found == {
        (1, 1, None, "no merchant"), (1, 2, None, "no merchant"), (1, 3, "Z", "not asked for"), (2, None, None, "no object"),
        (3, None, None, "no object"), (4, None, None, "unreadable"), (5, None, None, "no profiles"), (6, None, None, "no profiles"),
        (7, None, None, "no object"),
    }
    assert [r.normalized_merchant for r in enrichment.profile_batch_match(frame, batch).collect()] == ["A"]
