import math

import pytest
from pyspark.sql import functions as F

from gazelake.functions import answers as A, geometry as G, prompts as P, words as W
from gazelake.operators import packing, rewards as R


def pts(rows):
    return [(p["x"], p["y"]) for p in rows]


@pytest.mark.parametrize("text,expected", [
    ("[ 10, 20 ]", [(10, 20)]), ("[5-6]", [(5, 6)]), ("[-5, 3]", []), ("[3,4]", [(3, 4)]),
    ("{'Position': [1, 2]}", [(1, 2)]), ("[  7, 8]", []), ("No Objects", []), ("[1, 2] [3, 4]", [(1, 2), (3, 4)]),
    ("[99999999999999999999, 1]", [(2**63 - 1, 1)]),
])
def test_strict_points(one_row, text, expected):
    row = one_row({"t": f'"{text}"'}, A.points(A.normalized("t")))
    assert pts(row[0]) == expected


def test_tags(one_row):
    texts = {"a": "'<think> why </think> <answer> [1, 2] </answer>'", "b": "'plain [3, 4]'", "c": r"'<answer>[1, 2]\n[3, 4]</answer>'"}
    row = one_row(texts, A.answer("a"), A.reasoning("a"), A.answer("b"), A.answer("c"), A.format_reward("a"), A.format_reward("b"),
                  A.format_reward(F.concat("a", F.lit("\n"))))
    assert row[0] == "[1, 2]" and row[1] == "why" and row[2] == "plain [3, 4]"
    assert row[3].startswith("<answer>")  # a multi-line answer falls back to the whole text
    assert row[4] == 1.0 and row[5] == 0.0 and row[6] == 0.0


def test_structured_points(one_row):
    row = one_row({"t": "\"[{'Position': [1, 2]}, {'Other': [3, 4]}, {'Position': [5]}, {'Position': [6, 7, 8]}]\""}, A.structured_points("t"))
    assert pts(row[0]) == [(1.0, 2.0), (6.0, 7.0)]


def test_repair(one_row):
    row = one_row({"bad": "array(array(1), array(2, 3), array(4, 5, 6))", "gone": "array(array(1))", "none": "cast(array() as array<array<int>>)",
                   "w": "801D", "h": "600D"},
                  A.repaired("bad", "w", "h"), A.repaired("gone", "w", "h"), A.repaired("none", "w", "h"), A.well_formed("bad"))
    assert row[0] == [[2, 3]] and row[1] == [[400, 300]] and row[2] == [] and row[3] is False


def test_malformed_prediction_raises(one_row):
    with pytest.raises(Exception, match="two coordinates"):
        one_row({"bad": "array(array(1))"}, A.checked("bad"))


def test_paths(one_row):
    v = {"e": "cast(array() as array<double>)", "x": "array(1D, 2D, -1D, -1D)", "s": "array(0, 1, 0, 1)", "z": "array(0, 0)"}
    row = one_row(v, G.padded("e"), G.sentinel_length("x"), G.prefix("x", G.stop_length("s")), G.stop_length("z"), G.windows_of("x", 3),
                  G.windows_of("e", 1), G.floored("x"), G.denormalize("x", 1.0, 2.0))
    assert row[0] == [1.0, 1.0, 1.0] and row[1] == 2 and row[2] == [1.0, 2.0] and row[3] == 2
    assert row[4] == [[1.0, 2.0, -1.0], [2.0, -1.0, -1.0]] and row[5] == [] and row[7] == [3.0, 5.0, -1.0, -1.0]


def test_names(one_row):
    row = one_row({"p": "'vsgui/im.4b.png'", "t": "'txt_Lx'", "i": "'f4'"}, G.image_stem("p"), G.target_key("t"), G.image_path("i"))
    assert list(row) == ["im", "Lx", "vsgui10k-images/f4.png"]


def test_grid_edges(one_row):
    v = {"x": "array(-3D, 0D, 511D, 512D, 900D, 31.9D)", "y": "array(0D, 383D, 384D, -1D, 900D, 32D)"}
    row = one_row(v, G.grid_symbols("x", "y"), G.grid_letters(F.array(F.lit(511.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(76.0))))
    assert row[0] == [0, 176, 191, 15, 191, 16]
    assert row[1] == "ff"  # 511 spills into the next row of letters


def test_pixel_addresses(one_row):
    v = {"zero": "0D", "neg": "-2D", "far": "600D", "half": "0.5D"}
    row = one_row(v, G.pixel_index(F.col("zero"), 512, True), G.pixel_index(F.col("neg"), 512, False), G.pixel_index(F.col("far"), 512, False),
                  G.pixel_index(F.col("half"), 512, True), G.pixel_index(F.col("neg"), 512, True))
    assert list(row) == [511, 510, 511, 0, 509]


def test_repeats_round_half_to_even(one_row):
    v = {"s": "array(7, 8, 9)", "t": "array(125D, 75.9D, 24D)"}
    row = one_row(v, G.repeat_by_duration("s", "t"), G.repeat_by_duration("s", "t", 50, "floor"))
    assert row[0] == [7, 7, 8, 8] and row[1] == [7, 7, 8]


def test_turn_angles(one_row):
    v = {"x": "array(0D, 10D, 10D, 10D)", "y": "array(0D, 0D, 10D, 10D)"}
    angles = one_row(v, G.turn_angles(G.saccades("x", "y")))[0]
    assert angles[0] == pytest.approx(90) and math.isnan(angles[1])


def test_target_center(one_row):
    v = {"target_x": "10D", "target_width": "5D"}
    assert list(one_row(v, G.target_center(), G.target_center(anchor="center"))) == [12, 10]


def test_tokens(one_row):
    v = {"t": "'Hello, World -- it\\'s well-known (yes)... 3.14!'", "s": "' a  b c '", "e": "'a  b'"}
    row = one_row(v, W.caption_tokens("t"), W.words("s"), W.blank_split("e"), W.ngrams(W.words("e"), 3), W.word_characters("t"))
    assert row[0] == "hello world it 's well-known yes 3.14" and row[1] == ["a", "b", "c"] and row[2] == ["a", "", "b"]
    assert [(g["n"], g["gram"]) for g in row[3]] == [(1, "a"), (1, "b"), (2, "a b")]


def test_closest_length(one_row):
    v = {"l": "array(8, 12, 30)", "t": "10"}
    row = one_row(v, W.closest_length("l", "t"), W.closest_length("l", "t", "shortest"), W.closest_length("l", "t", "average"))
    assert row[0] == 8 and row[1] == 8 and row[2] == pytest.approx(50 / 3)
    with pytest.raises(ValueError):
        W.closest_length("l", "t", "longest")


def test_chat(one_row):
    conv = "array(named_struct('from','gpt','value','hi'), named_struct('from','human','value','<image> a <image>'), named_struct('from','gpt','value','b'))"
    row = one_row({"c": conv, "n": "array(2, 1)"}, P.rendered_chat("c"), P.conversation_with_media("c", "n", "n"))
    assert row[0] == ("<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n<|im_start|>user\n<image> a <image><|im_end|>\n"
                      "<|im_start|>assistant\nb<|im_end|>\n")
    pad = "<|image_pad|>"
    assert row[1][1]["value"] == f"<|vision_start|>{pad * 2}<|vision_end|> a <|vision_start|>{pad}<|vision_end|>"


def test_messages(one_row):
    row = one_row({"problem": "'find it'"}, P.rl_messages(), P.rl_messages(with_image=False))
    assert row[0][0]["content"][1]["text"] == "find it" and [m["role"] for m in row[1]] == ["system", "user"]


def test_token_columns(one_row):
    v = {"ids": "array(5, 9, 2, 9)", "r": "array(-1D, -2D)", "p": "array(-1.5D, -2D)"}
    row = one_row(v, R.answer_length("ids", 9), R.answer_length("ids", 7), R.token_kl("r", "p"), R.last_tokens("ids", 3), R.last_tokens("ids", 9))
    assert row[0] == 2 and row[1] == 4 and row[3] == [9, 2, 9] and row[4] == [5, 9, 2, 9]
    assert row[2] == pytest.approx([math.exp(0.5) - 1.5, 0.0])


def test_label_mask_and_frames(one_row):
    turns = "array(named_struct('role','system','ids',array(1,2)), named_struct('role','user','ids',array(3)), named_struct('role','assistant','ids',array(4,5,6,7,8)))"
    v = {"t": turns, "frames": "100", "fps": "10D", "few": "3", "g": "array(named_struct('t',1,'h',10,'w',10), null)"}
    row = one_row(v, packing.label_mask("t"), packing.frame_plan("frames", "fps"), packing.frame_plan("few", "fps"), packing.token_count(F.lit(5), "g"))
    assert row[0] == [-100] * 6 + [7, 8]
    assert row[1] == [0, 33, 66, 99] and row[2] == [0, 1, 2] and row[3] == 51
