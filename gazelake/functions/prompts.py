"""Prompt, conversation and chat text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .geometry import col

# fixed values: prompt texts and chat markers
QUESTION = ("Given the image with width %d and height %d, what is the scanpath for the visual search task "
            "on this GUI? The text on the target element is \"%s\".\n")
THINK_RULES = ("Output the thinking process in <think> </think> and final answer in <answer> </answer> tags. "
               "The output answer format should be as follows:\n"
               "<think> ... </think> <answer>The scanpath is [x1, y1] [x2, y2] ...</answer>\n"
               "Please strictly follow the format.\n")
RL_PROBLEM = ("Find the target object that is \"%s\" in the image, and provide the trajectory of fixation points "
              "matching human behavior to find this target object (x-coordinate between 0 and %d, y-coordinate "
              "between 0 and %d, integer; the first fixation point is near the middle of the image).\n"
              "If no target object is '%s' in the image, return 'No Objects'.\n"
              "Output the thinking process in <think> </think>, and final answer of fixation points in "
              "<answer> </answer> tags. The output answer format should be as follows:\n"
              "<think> ... </think> <answer>[{'Position': [x, y]}, ...]</answer>\n"
              "Please strictly follow the format.")
SYSTEM_PROMPT = ("A conversation between User and Assistant. The user asks a question, and the Assistant solves it. "
                 "The assistant first thinks about the reasoning process in the mind and then provides the user with "
                 "the answer. The reasoning process and answer are enclosed within <think> </think> and <answer> "
                 "</answer> tags, respectively, i.e., <think> reasoning process here </think><answer> answer here "
                 "</answer>")
BLOCK = "<|im_start|>%s\n%s<|im_end|>\n"
CHAT_SYSTEM = "You are a helpful assistant."
ROLES = {"human": "user", "gpt": "assistant"}
VISION_START, VISION_END = "<|vision_start|>", "<|vision_end|>"


def question(width="width", height="height", target="target") -> Column:
    return F.format_string(QUESTION, col(width).cast("int"), col(height).cast("int"), col(target))


def inference_prompt(**columns) -> Column:
    return F.concat(question(**columns), F.lit(THINK_RULES))


def listed_points(x="x", y="y") -> Column:
    """``[x, y] [x, y] `` with floored coordinates, each followed by a blank."""
    pts = F.arrays_zip(col(x).alias("x"), col(y).alias("y"))
    return F.array_join(F.transform(pts, lambda p: F.concat(
        F.lit("["), F.floor(p["x"]).cast("string"), F.lit(", "), F.floor(p["y"]).cast("string"), F.lit("] "))), "")


def _turns(human, gpt) -> Column:
    return F.array(*[F.struct(F.lit(who).alias("from"), text.alias("value"))
                     for who, text in (("human", human), ("gpt", gpt))])


def training_conversation(x="x", y="y", **columns) -> Column:
    return _turns(F.concat(question(**columns), F.lit("<image>")),
                  F.concat(F.lit("The scanpath is "), listed_points(x, y)))


def reasoning_conversation(explanation="explanation", x="x", y="y", **columns) -> Column:
    reply = F.concat(F.lit("<think>"), col(explanation), F.lit("</think> <answer>The scanpath is "),
                     F.rtrim(listed_points(x, y)), F.lit("</answer>"))
    return _turns(F.concat(question(**columns), F.lit(THINK_RULES), F.lit("<image>")), reply)


def rl_problem(width="width", height="height", target="target") -> Column:
    return F.format_string(RL_PROBLEM, col(target), col(width).cast("int"), col(height).cast("int"), col(target))


def rl_solution(x="x", y="y") -> Column:
    pts = F.arrays_zip(col(x).alias("x"), col(y).alias("y"))
    items = F.transform(pts, lambda p: F.concat(
        F.lit("{'Position': ["), F.floor(p["x"]).cast("string"), F.lit(", "), F.floor(p["y"]).cast("string"), F.lit("]}")))
    return F.concat(F.lit("<answer>["), F.array_join(items, ", "), F.lit("]</answer>"))


def rl_messages(problem="problem", with_image=True) -> Column:
    """Prompt messages: one user turn with image and text, or system and user text."""
    if with_image:
        parts = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
                        F.struct(F.lit("text").alias("type"), col(problem).alias("text")))
        return F.array(F.struct(F.lit("user").alias("role"), parts.alias("content")))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")),
                   F.struct(F.lit("user").alias("role"), col(problem).alias("content")))


def without_leading_reply(conversation) -> Column:
    """Drop the first turn when it is not the human's."""
    c = col(conversation)
    return F.when((F.size(c) > 0) & (F.get(c, F.lit(0))["from"] != "human"),
                  F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))).otherwise(c)


def role_of(name) -> Column:
    out = name
    for old, new in ROLES.items():
        out = F.when(name == old, F.lit(new)).otherwise(out)
    return out


def _block(role, content) -> Column:
    return F.format_string(BLOCK, role, content)


def rendered_chat(conversation, system=CHAT_SYSTEM) -> Column:
    body = F.transform(without_leading_reply(conversation), lambda m: _block(role_of(m["from"]), m["value"]))
    return F.concat(_block(F.lit("system"), F.lit(system)), F.array_join(body, ""))


def expanded_media(text, counts, marker="<image>", pad="<|image_pad|>") -> Column:
    """Replace the i-th marker by start, ``counts[i]`` pads and end."""
    parts = F.split(col(text), marker, -1)
    last = F.size(parts) - 1
    replaced = F.transform(parts, lambda p, i: F.when(i < last, F.concat(
        p, F.lit(VISION_START), F.repeat(F.lit(pad), F.coalesce(F.get(col(counts), i), F.lit(0))), F.lit(VISION_END)
    )).otherwise(p))
    return F.array_join(replaced, "")


def conversation_with_media(conversation, image_counts, video_counts) -> Column:
    """Expand the media markers of all user turns, numbering media across turns."""
    def markers(text, marker):
        return F.size(F.split(text, marker, -1)) - 1

    c = col(conversation)

    def seen_before(i, marker):
        users = F.filter(F.slice(c, F.lit(1), i), lambda b: role_of(b["from"]) == "user")
        return F.aggregate(users, F.lit(0), lambda acc, b: acc + markers(b["value"], marker))

    def expand(m, i):
        text = m["value"]
        for marker, pad, counts in (("<image>", "<|image_pad|>", image_counts), ("<video>", "<|video_pad|>", video_counts)):
            rest = F.slice(col(counts), seen_before(i, marker) + 1, F.size(col(counts)))
            text = expanded_media(text, rest, marker, pad)
        user = role_of(m["from"]) == "user"
        return F.struct(m["from"].alias("from"), F.when(user, text).otherwise(m["value"]).alias("value"))

    return F.transform(c, expand)
