import json

from pyspark.sql import functions as F

from helpers import orders, products, tuples
from shelfline.functions import rules
from shelfline.functions.text import is_blank, sole_json_value, stable_uuid, utf16_length, utf16_prefix
from shelfline.operators import events, notifications, quality


def column(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_strict_json(spark):
    texts = ['{"a":"x"}', ' {"a":1} ', '[1,2]', "5", '{"a":"x"} tail', '{"a":1}{"b":2}', '{"a":1}]', '{"a":1},{"b":2}', "{'a':1}", '{"a":NaN}', "", "null x", None]
    got = [r[0] for r in column(spark, texts).orderBy("i").select(sole_json_value(F.col("t"))).collect()]
    assert got == ['{"a":"x"}', '{"a":1}', "[1,2]", "5", *[None] * 9]


def test_text_helpers(spark):
    df = column(spark, ["ab", "\U0001f600", "", None, " \t\n", " x "])
    assert [r[0] for r in df.orderBy("i").select(utf16_length(F.col("t"))).collect()] == [2, 2, 0, None, 3, 3]
    assert [r[0] for r in df.orderBy("i").select(is_blank(F.col("t"))).collect()] == [False, False, True, True, True, False]
    ids = [r[0] for r in df.orderBy("i").select(stable_uuid(F.lit("k"), F.col("i").cast("string"))).collect()]
    assert len(set(ids)) == 6 and all(len(i) == 36 for i in ids)


def test_product_event_envelope(spark):
    catalog = products(spark, [("a", 3, "X")])
    made = json.loads(events.product_events(catalog, "PRODUCT_CREATED").first().message)
    assert (made["eventType"], made["entityId"]) == ("PRODUCT_CREATED", "a")
    payload = made["payload"]
    assert payload["price"] == {"amount": 10.0, "currency": "USD"} and payload["stock"] == {"quantity": 3, "empty": False}
    assert payload["lowStock"] is True and payload["createdAt"] == "2024-01-01T00:00:00.000000Z"
    gone = json.loads(events.product_events(catalog, "PRODUCT_DELETED").first().message)
    assert gone == {"eventType": "PRODUCT_DELETED", "entityId": "a", "payload": None}


def test_order_event(spark):
    placed = orders(spark, [("c9", "a", 1, "1.00", "CONFIRMED", "2024-01-01")])
    assert json.loads(events.order_placed_events(placed).first().message) == {"orderId": "o0", "customerId": "c9", "status": "CONFIRMED"}


def test_event_rules(spark):
    parsed = spark.createDataFrame(
        [("1", "PRODUCT_CREATED", "e"), ("2", "OTHER", "e"), ("3", None, ""), ("4", "PRODUCT_DELETED", None)],
        "message_id string, eventType string, entityId string",
    )
    bad = {r.message_id: len(r.reasons) for r in quality.invalid_requests(parsed, rules.event_rules()).collect()}
    assert bad == {"2": 1, "3": 2, "4": 1}


def notify(spark, rows):
    return spark.createDataFrame(rows, "userId string, message string, channel string")


def test_channel_routing(spark):
    long = "".join(chr(97 + i % 26) for i in range(150))
    routed = notifications.route_notifications(notify(spark, [("u", long, c) for c in ("email", "sms", "push", "slack", "fax", "EMAIL")]))
    got = {r.channel: (r.preview, r.chars) for r in routed.accepted.collect()}
    assert got == {"email": (long[:80], None), "sms": (None, 150), "push": (long[:60], None), "slack": (long[:100], None)}
    refused = {r.channel: r.reasons for r in routed.rejects.collect()}
    assert refused["fax"] == ["Unknown channel 'fax'. Registered channels: email, sms, push, slack"] and "EMAIL" in refused


def test_notify_fields_are_required(spark):
    routed = notifications.route_notifications(notify(spark, [(None, "m", "sms"), ("u", "", "sms"), ("", None, None), ("u", " ", "sms")]))
    assert sorted(map(tuple, (r.reasons for r in routed.rejects.collect()))) == [
        ("message should not be empty",),
        ("userId should not be empty",),
        ("userId should not be empty", "message should not be empty", "channel should not be empty"),
    ]
    assert routed.accepted.count() == 1


def test_confirmation_text(spark):
    row = notifications.order_confirmations(orders(spark, [("c9", "a", 1, "989.90", "CONFIRMED", "2024-01-01")])).first()
    assert (row.recipient, row.order_id, row.subject) == ("c9@example.com", "o0", "Order Confirmation")
    assert row.body == "Dear customer,\n\nYour order o0 has been placed.\nTotal: $989.90\n\nThank you!"


# The wording of prompts and mails.


def test_prompt(spark):
    df = spark.createDataFrame([("PRODUCT_UPDATED", '{"a":1}'), ("ODD", None)], "eventType string, payload string")
    vip = {r.eventType: r.prompt for r in notifications.notification_prompts(df, "premium VIP customer").collect()}
    assert vip["PRODUCT_UPDATED"] == (
        "Event: PRODUCT_UPDATED\nAn existing product has been updated (price, description, or stock).\n"
        'Product details: {"a":1}\nTarget audience: premium VIP customer\n\nGenerate an appropriate notification for this event.'
    )
    assert vip["ODD"].startswith("Event: ODD\nEvent type: ODD\nTarget audience:")
    assert "Target audience: general customer" in notifications.notification_prompts(df).first().prompt


def test_reply_parsing(spark):
    good = '{"subject":"New lantern","body":"It glows.","channel":"email"}'
    replies = [
        good,
        f"```json\n{good}\n```",
        f"```\n{good}```",
        f"\n  {good}\n\t",
        "There is nothing to say about this one",
        '{"subject":"","body":"b","channel":"push"}',
        '{"subject":"s","channel":"push"}',
        f"{good} As you asked.",
        "null",
        f"[{good}]",
        json.dumps({"subject": "s" * 61, "body": "b", "channel": "fax"}),
        None,
    ]
    parsed = notifications.parse_replies(column(spark, replies, "reply"))
    accepted = {r.i: r for r in parsed.accepted.collect()}
    assert sorted(accepted) == [0, 1, 2, 3, 10]
    assert all((accepted[i].subject, accepted[i].body, accepted[i].channel) == ("New lantern", "It glows.", "email") for i in range(4))
    assert [(accepted[i].subject_too_long, accepted[i].channel_unlisted) for i in (0, 10)] == [(False, False), (True, True)]
    rejects = {r.i: r.reasons for r in parsed.rejects.collect()}
    assert sorted(rejects) == [4, 5, 6, 7, 8, 9, 11]
    assert rejects[4] == ["non-JSON response: There is nothing to say about this one..."]


def test_reply_excerpt_is_a_hundred_characters(spark):
    reject = notifications.parse_replies(column(spark, ["x" * 300], "reply")).rejects.first()
    assert reject.reasons == ["non-JSON response: " + "x" * 100 + "..."] and reject.reply == "x" * 300


def test_batch_dead_letters_need_five_failures(spark):
    failed = column(spark, ["a"] * 5 + ["b"] * 4 + ["c"] * 7, "message_id").withColumn("raw", F.format_string("try %d", 99 - F.col("i")))
    assert sorted(tuples(events.dead_letter(failed, order="i"))) == [("a", 5, "try 95"), ("c", 7, "try 84")]
    assert sorted(tuples(events.dead_letter(failed, 7, order="i"))) == [("c", 7, "try 84")]


def test_previews_and_excerpts_count_utf16_units(spark):
    texts = ["\U0001f600" * 90, "a" + "\U0001f600" * 90, "x" * 81, "é" * 80, "", "\U0001f600" * 40]
    got = [r[0] for r in column(spark, texts).orderBy("i").select(utf16_prefix(F.col("t"), 80)).collect()]
    assert got == ["\U0001f600" * 40, "a" + "\U0001f600" * 39, "x" * 80, "é" * 80, "", "\U0001f600" * 40]
    request = spark.createDataFrame([("u", texts[0], "email")], "userId string, message string, channel string")
    assert notifications.route_notifications(request).accepted.first().preview == "\U0001f600" * 40
    excerpt = notifications.parse_replies(column(spark, ["y" + "\U0001f600" * 60], "reply")).rejects.first().reasons[0]
    assert excerpt == "non-JSON response: y" + "\U0001f600" * 49 + "..."


def test_delivery_counters(spark):
    routed = spark.createDataFrame(
        [("a", "failed")] * 5 + [("a", "handled")] + [("b", "failed")] * 4 + [("c", "unknown")], "message_id string, outcome string"
    )
    assert tuples(events.delivery_counters(routed)) == [(11, 2, 9, 1)]
    assert tuples(events.delivery_counters(routed.where("false"))) == [(0, 0, 0, 0)]
