"""Notification text: channel routing, confirmations, prompts and reply parsing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from shelfline.functions.rules import Split, broken_rules, notify_request_rules
from shelfline.functions.text import STRICT_JSON, is_empty, once, sole_json_value, trim_whitespace, utf16_length, utf16_prefix

# Channels in order, and how many UTF-16 units of the message each previews.
CHANNELS = ("email", "sms", "push", "slack")
PREVIEW_CHARS = {"email": 80, "push": 60, "slack": 100}

# Prompt wording.
EVENT_DESCRIPTIONS = {
    "PRODUCT_CREATED": "A new product has just been added to the catalog.",
    "PRODUCT_UPDATED": "An existing product has been updated (price, description, or stock).",
    "PRODUCT_DELETED": "A product has been removed from the catalog.",
}
DEFAULT_AUDIENCE = "general customer"
PROMPT_CLOSING = "Generate an appropriate notification for this event."

# What a reply should keep to; replies that do not are flagged, not refused.
SUBJECT_CHARS = 60
REPLY_CHANNELS = ("email", "push", "sms")


def route_notifications(requests: DataFrame) -> Split:
    """Requests with the ``preview`` or character count their channel logs, and refused requests.

    ``requests`` has ``userId``, ``message`` and ``channel``. The channel
    table is fixed, so it is an expression rather than a join.
    """
    unknown = F.concat(
        F.lit("Unknown channel '"), F.col("channel"), F.lit("'. Registered channels: " + ", ".join(CHANNELS))
    )
    field_errors = broken_rules(notify_request_rules())
    reasons = F.when(F.size(field_errors) > 0, field_errors).when(
        ~F.col("channel").isin(*CHANNELS), F.array(unknown)
    )
    checked = requests.withColumn("reasons", reasons)
    preview = F.lit(None).cast("string")
    for channel, size in PREVIEW_CHARS.items():
        preview = F.when(F.col("channel") == channel, utf16_prefix(F.col("message"), size)).otherwise(preview)
    routed = (
        checked.where(F.col("reasons").isNull())
        .drop("reasons")
        .withColumn("preview", preview)
        .withColumn("chars", F.when(F.col("channel") == "sms", utf16_length(F.col("message"))))
    )
    return Split(routed, checked.where(F.col("reasons").isNotNull()))


def order_confirmations(orders: DataFrame) -> DataFrame:
    """Recipient, subject and body of the confirmation mail of every order."""
    # The wording of the mail.
    body = F.concat(
        F.lit("Dear customer,\n\nYour order "),
        F.col("id"),
        F.lit(" has been placed.\nTotal: $"),
        F.col("amount").cast("string"),
        F.lit("\n\nThank you!"),
    )
    return orders.select(
        F.concat(F.col("customer_id"), F.lit("@example.com")).alias("recipient"),
        F.col("id").alias("order_id"),
        F.col("amount").alias("total"),
        F.lit("Order Confirmation").alias("subject"),
        body.alias("body"),
    )


def notification_prompts(events: DataFrame, audience: Column | str | None = None) -> DataFrame:
    """Add the ``prompt`` text that asks for a notification about each event.

    ``events`` has ``eventType`` and ``payload`` (JSON text or null).
    """
    wanted = F.lit(audience) if isinstance(audience, str) else audience
    reader = F.lit(DEFAULT_AUDIENCE) if wanted is None else F.coalesce(wanted, F.lit(DEFAULT_AUDIENCE))
    description = F.concat(F.lit("Event type: "), F.col("eventType"))
    for event_type, text in EVENT_DESCRIPTIONS.items():
        description = F.when(F.col("eventType") == event_type, F.lit(text)).otherwise(description)
    details = F.when(is_empty(F.col("payload")), F.lit("")).otherwise(
        F.concat(F.lit("\nProduct details: "), F.col("payload"))
    )
    prompt = F.concat(
        F.lit("Event: "), F.col("eventType"), F.lit("\n"),
        description, details,
        F.lit("\nTarget audience: "), reader,
        F.lit("\n\n" + PROMPT_CLOSING),
    )
    return events.withColumn("prompt", prompt)


def parse_replies(replies: DataFrame) -> Split:
    """Subject, body and channel of each model ``reply``; refused unless JSON with all three.

    Code fences around the JSON are dropped. ``subject_too_long`` and
    ``channel_unlisted`` flag replies that ignored the instructions.
    """
    # The fences that replies come in.
    unfenced = F.regexp_replace(F.regexp_replace("reply", "```json\n?", ""), "```\n?", "")
    names = ("subject", "body", "channel")
    read = F.from_json(
        sole_json_value(trim_whitespace(unfenced)), ", ".join(f"{name} string" for name in names), STRICT_JSON
    )
    complete = once(read, lambda f: F.when(~reduce(or_, [is_empty(f[name]) for name in names]), f))
    parsed = replies.withColumn("_fields", complete)
    excerpt = F.concat(F.lit("non-JSON response: "), utf16_prefix(F.col("reply"), 100), F.lit("..."))
    accepted = (
        parsed.where(F.col("_fields").isNotNull())
        .select(*replies.columns, "_fields.subject", "_fields.body", "_fields.channel")
        .withColumn("subject_too_long", utf16_length(F.col("subject")) > SUBJECT_CHARS)
        .withColumn("channel_unlisted", ~F.col("channel").isin(*REPLY_CHANNELS))
    )
    rejects = parsed.where(F.col("_fields").isNull()).drop("_fields").withColumn("reasons", F.array(excerpt))
    return Split(accepted, rejects)
