"""Chat messages (array of role and content) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from talkloom.functions.text import bound, decode_each, norm_text, norm_text_each, strip, tidy_untagged, untag

# Message type, prompts, role names.
MESSAGES = "array<struct<role:string,content:string>>"
POST_PROMPT = "Write a tweet in my style."
PARAGRAPH_PROMPT = "Write a paragraph in my signature style about: "
PLACEHOLDER_PROMPT = "..."
GENERIC_PREFIX = "write a"
REPOST_PREFIX = "rt"
MODEL_ROLE = "model"
# Role initials of dialogs that can be repaired: an optional system message,
# then user and assistant by turns. The opening prompt may be missing before an
# assistant, and one trailing run of another role is dropped.
REPAIRABLE = "^(?:a+|s*u+a+)(?:u+a+)*+(?:u+|s+)?$"


def message(role: Column | str, content: Column) -> Column:
    role = role if isinstance(role, Column) else F.lit(role)
    return F.struct(role.alias("role"), content.alias("content"))


def map_role(role: Column) -> Column:
    """assistant/model, user, system in any case and padding; all else is user."""
    name = F.lower(strip(F.coalesce(role, F.lit(""))))
    return F.when(name.isin("assistant", "model"), "assistant").when(name == "system", "system").otherwise("user")


def is_model_role(role: Column) -> Column:
    return F.lower(F.coalesce(role, F.lit(""))).isin("assistant", "model")


def filled_messages(messages: Column) -> Column:
    """Messages with any content; one of spaces only counts as filled."""
    return F.filter(messages, lambda m: F.coalesce(m["content"], F.lit("")) != "")


def role_shape(messages: Column) -> Column:
    """Initials of the mapped roles in order."""
    return F.array_join(F.transform(messages, lambda m: F.substring(map_role(m["role"]), 1, 1)), "")


def untagged_messages(messages: Column) -> Column:
    """Messages with content, roles mapped, tags taken out of the texts."""
    return F.transform(filled_messages(messages), lambda m: message(map_role(m["role"]), untag(m["content"])))


def decoded_messages(untagged: Column) -> Column:
    """Untagged messages with their texts decoded and tidied."""
    texts = decode_each(F.transform(untagged, lambda m: m["content"]))
    return F.zip_with(untagged, texts, lambda m, text: message(m["role"], text))


def clean_messages(messages: Column) -> Column:
    """Drop messages without content, map roles, normalise texts."""
    return decoded_messages(untagged_messages(messages))


def last_message(messages: Column) -> Column:
    return F.get(messages, F.size(messages) - 1)


def is_repost(messages: Column) -> Column:
    """The closing message is the assistant's and its text begins with ``rt``."""
    last = last_message(messages)
    text = F.lower(strip(last["content"]))
    return F.coalesce((last["role"] == "assistant") & F.startswith(text, F.lit(REPOST_PREFIX)), F.lit(False))


def merge_runs(messages: Column) -> Column:
    """Join neighbouring messages of the same role with a blank line between them.

    Most dialogs have no such neighbours, as their role initials tell, and stay
    as they are. The others are cut by position (run starts, then slices), which
    is linear in the number of messages.
    """
    size = F.size(messages)
    initials = F.array_join(F.transform(messages, lambda m: F.substring(m["role"], 1, 1)), "")
    has_runs = F.rlike(initials, F.lit(r"(.)\1"))
    role_at = lambda i: F.get(messages, i)["role"]
    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(size))
    spans = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))

    def merged(span: Column) -> Column:
        first = F.get(messages, span["start"])
        run = F.slice(messages, span["start"] + 1, span["end"] - span["start"])
        parts = F.filter(F.transform(run, lambda m: m["content"]), lambda text: text != "")
        several = span["end"] - span["start"] > 1
        return message(
            first["role"],
            F.when(several, strip(F.array_join(parts, "\n\n"))).otherwise(first["content"]),
        )

    return F.when(has_runs, F.transform(spans, merged)).otherwise(messages)


def user_turns(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] == "user")


def is_generic_prompt(prompt: Column) -> Column:
    text = F.lower(prompt)
    return (text == PLACEHOLDER_PROMPT) | F.startswith(text, F.lit(GENERIC_PREFIX))


def has_generic_prompt(messages: Column) -> Column:
    """The last user turn is a generic prompt."""
    return F.coalesce(is_generic_prompt(last_message(user_turns(messages))["content"]), F.lit(False))


def untagged_answer(messages: Column) -> Column:
    """The last assistant text without tags; empty without any."""
    return untag(bound(F.filter(messages, lambda m: is_model_role(m["role"])), lambda found: last_message(found)["content"]))


def answer_key(untagged: Column) -> Column:
    """``dialog_key`` of a repaired dialog from its :func:`untagged_answer`."""
    return F.sha2(F.lower(tidy_untagged(untagged)), 256)


def dialog_key(messages: Column, repaired: bool = False) -> Column:
    """SHA-256 of the last assistant text, normalised once more and lower-cased.

    A dialog without any assistant message is keyed by all its texts; repaired
    dialogs always have one, so that branch can be left out.
    """
    answer = last_message(F.filter(messages, lambda m: is_model_role(m["role"])))
    text = norm_text(answer["content"])
    if not repaired:
        unanswered = F.when(answer.isNull(), messages).otherwise(F.array().cast(MESSAGES))
        stitched = F.array_join(norm_text_each(F.transform(unanswered, lambda m: m["content"])), " ")
        text = F.when(answer.isNull(), stitched).otherwise(text)
    return F.sha2(F.lower(text), 256)


def style_example(text: Column, prompt: Column | str = POST_PROMPT, role: str = MODEL_ROLE) -> Column:
    """One prompt, one answer."""
    prompt = prompt if isinstance(prompt, Column) else F.lit(prompt)
    return F.array(message("user", prompt), message(role, text))


def paragraph_prompt(topics: Column) -> Column:
    return F.concat(F.lit(PARAGRAPH_PROMPT), F.array_join(topics, ", "), F.lit("."))


def roles_by_distance(texts: Column, role: str = MODEL_ROLE) -> Column:
    """Messages from chain texts (oldest first): the end answers, roles alternate backwards."""
    return F.transform(
        texts,
        lambda text, i: message(F.when((F.size(texts) - 1 - i) % 2 == 1, F.lit("user")).otherwise(F.lit(role)), text),
    )


def render_chat(messages: Column, template: str = "{role}: {content}", separator: str = "\n") -> Column:
    """One training text per dialog; ``template`` is filled for every message."""
    before, rest = template.split("{role}")
    between, after = rest.split("{content}")

    def line(m: Column) -> Column:
        return F.concat(
            F.lit(before), F.coalesce(m["role"], F.lit("user")),
            F.lit(between), F.coalesce(m["content"], F.lit("")), F.lit(after),
        )

    return F.coalesce(F.array_join(F.transform(messages, line), separator), F.lit(""))
