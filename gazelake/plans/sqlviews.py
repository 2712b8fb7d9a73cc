"""The same derived tables as SQL text, for checking queries in another engine."""

FIXATIONS = """
fx_r AS (
  SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events
), fx_g AS (
  SELECT event_id, user_id, CAST(floor(rn / 12) AS bigint) AS trial, CAST(rn % 12 AS int) AS pos,
         CAST(floor(user_id / 100) AS bigint) * 24
           + (CAST(floor(rn / 12) AS bigint) % 6) * 4 + user_id % 4 AS image_no
  FROM fx_r
), fixations AS (
  SELECT concat('im', image_no, '_u', user_id, '_tr', trial) AS img_usr_tgt,
         concat('im', image_no) AS image, concat('u', user_id) AS username,
         concat('txt_T', image_no % 7) AS target_id,
         CAST(800 + (image_no % 4) * 160 AS double) AS width, CAST(600 + (image_no % 3) * 120 AS double) AS height,
         CASE image_no % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'desktop' ELSE 'mobile' END AS ui_type,
         trial, pos, image_no, user_id,
         CAST(((event_id * 7919) % 5) * 150 + (event_id * 31) % 120 AS double) AS x,
         CAST(((event_id * 104729) % 4) * 140 + (event_id * 17) % 100 AS double) AS y,
         CAST(100 + ((event_id * 13) % 9) * 50 AS double) / 1000 AS t
  FROM fx_g
)"""

PREDICTED = FIXATIONS + """, pred_fixations AS (
  SELECT f.img_usr_tgt, f.image, f.username, f.target_id, f.width, f.height, f.ui_type, f.trial, f.user_id, g.gen_no, f.pos,
         CAST(greatest(0, f.x + CAST((f.pos * 37 + g.gen_no * 11) % 81 AS double) * (1 + g.gen_no) - 40 * (1 + g.gen_no)) AS double) AS px,
         CAST(greatest(0, f.y + CAST((f.pos * 53 + g.gen_no * 7) % 61 AS double) * (1 + g.gen_no) - 30 * (1 + g.gen_no)) AS double) AS py
  FROM fixations f CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS gen_no) g
  WHERE (f.pos + g.gen_no) % 5 <> 4
)"""

TRIALS = """, trials AS (
  SELECT img_usr_tgt, any_value(image) AS image, any_value(username) AS username, any_value(target_id) AS target_id,
         any_value(width) AS width, any_value(height) AS height, any_value(ui_type) AS ui_type,
         any_value(trial) AS trial, any_value(user_id) AS user_id, any_value(image_no) AS image_no,
         list(x ORDER BY pos) AS x, list(y ORDER BY pos) AS y, list(t ORDER BY pos) AS t
  FROM fixations GROUP BY img_usr_tgt
)"""

PAIRS = PREDICTED + TRIALS + """, answers AS (
  SELECT img_usr_tgt, gen_no, list(px ORDER BY pos) AS px, list(py ORDER BY pos) AS py
  FROM pred_fixations GROUP BY img_usr_tgt, gen_no
), pairs AS (SELECT t.*, a.gen_no, a.px, a.py FROM trials t JOIN answers a USING (img_usr_tgt))"""

_PAD = "list_concat({v}, list_transform(range(0, greatest(0, 3 - len({v}))), lambda i: 1.0::double))"


def _scaled(v, size, to):
    return f"list_transform({v}, lambda v: v / {size} * {to}.0::double)"


CANVAS = PAIRS + f""", scaled AS (
  SELECT img_usr_tgt, gen_no, image, username, target_id, ui_type, trial, user_id, image_no, width, height,
         {_scaled('x', 'width', 512)} AS x, {_scaled('y', 'height', 384)} AS y,
         list_transform(t, lambda v: v * 1000) AS t,
         {_scaled('px', 'width', 512)} AS px, {_scaled('py', 'height', 384)} AS py FROM pairs
), canvas AS (
  SELECT * REPLACE ({_PAD.format(v='x')} AS x, {_PAD.format(v='y')} AS y, {_PAD.format(v='t')} AS t,
                    {_PAD.format(v='px')} AS px, {_PAD.format(v='py')} AS py) FROM scaled
)"""


def grid_cells(xs, ys, xbin=16, ybin=12):
    def cell(v, size, bins):
        return f"floor(trunc(CASE WHEN greatest({v}, 0) >= {size} THEN {size - 1} ELSE greatest({v}, 0) END) * {bins} / {size})"
    return (f"list_transform(range(1, len({xs}) + 1), lambda i: "
            f"({cell(f'{ys}[i]', 384, ybin)} * {xbin} + {cell(f'{xs}[i]', 512, xbin)})::int)")


def grid_letters(xs, ys):
    return (f"array_to_string(list_transform(range(1, len({xs}) + 1), lambda i: "
            f"chr((97 + floor(trunc({xs}[i]) / 102) + floor(trunc({ys}[i]) / 76) * 5)::int)), '')")


def repeated(symbols, durations, rounding):
    n = f"round_even(trunc({durations}[i]) / 50, 0)" if rounding == "half_even" else f"trunc({durations}[i] / 50)"
    return (f"flatten(list_transform(range(1, least(len({symbols}), len({durations})) + 1), lambda i: "
            f"list_transform(range(0, ({n})::bigint), lambda r: {symbols}[i])))")


def alignment(a, b, similarity):
    """Last cell of the gap-free score matrix, one list per matrix row.

    ``similarity`` uses ``cur[1]`` (symbol of a) and ``{b}[j[1]::int]``.
    """
    return (f"list_reduce(list_transform({a}, lambda v: [v::double]), lambda prev, cur: "
            f"list_reduce(list_transform(range(1, len({b}) + 1), lambda k: [k::double]), lambda acc, j: "
            f"list_append(acc, greatest(prev[j[1]::int] + {similarity}, prev[j[1]::int + 1], acc[-1])), [0.0::double]), "
            f"list_transform(range(0, len({b}) + 1), lambda z: 0.0::double))[-1]")


def common(a, b):
    return alignment(a, b, f"CASE WHEN cur[1] = {b}[j[1]::int] THEN 1.0 ELSE 0.0 END")


def grid_alignment(a, b):
    other = f"{b}[j[1]::int]"
    return alignment(a, b, f"(3.5 - sqrt(pow(cur[1] % 16 - {other} % 16, 2) + pow(floor(cur[1] / 16) - floor({other} / 16), 2)))")


COMPLETIONS = PAIRS + """, completions AS (
  SELECT img_usr_tgt AS prompt_id, gen_no, user_id, width, height, ui_type, image, target_id, username, trial,
         concat('The scanpath is ', array_to_string(list_transform(range(1, len(x) + 1), lambda i:
           concat('[', floor(x[i])::bigint, ', ', floor(y[i])::bigint, ']')), ' ')) AS solution,
         concat('The scanpath is ', array_to_string(list_transform(range(1, len(px) + 1), lambda i:
           concat('[', floor(px[i])::bigint, ', ', floor(py[i])::bigint, ']')), ' ')) AS said
  FROM pairs
), logged AS (
  SELECT * EXCLUDE (said), CASE WHEN user_id % 13 = 12 THEN 'No Objects' WHEN user_id % 11 = 10 THEN said
         ELSE concat('<think>look</think> <answer>', said, '</answer>') END AS content FROM completions
), answered AS (
  SELECT *, regexp_replace(CASE WHEN regexp_matches(content, '<answer>(.*?)</answer>')
                  THEN regexp_extract(content, '<answer>(.*?)</answer>', 1) ELSE content END, '^\\s+|\\s+$', '', 'g') AS answer,
         regexp_replace(CASE WHEN regexp_matches(content, '<think>(.*?)</think>')
                  THEN regexp_extract(content, '<think>(.*?)</think>', 1) ELSE content END, '^\\s+|\\s+$', '', 'g') AS think FROM logged
), tidy AS (
  SELECT *, replace(replace(replace(replace(answer, '[ ', '['), ' ]', ']'), ',', ' '), '-', ' ') AS a_text,
         replace(replace(replace(replace(solution, '[ ', '['), ' ]', ']'), ',', ' '), '-', ' ') AS s_text FROM answered
), parsed AS (
  SELECT *, list_transform(regexp_extract_all(a_text, '\\[(\\d+) \\s*(\\d+)\\]', 1), lambda v: v::double) AS ax,
         list_transform(regexp_extract_all(a_text, '\\[(\\d+) \\s*(\\d+)\\]', 2), lambda v: v::double) AS ay,
         list_transform(regexp_extract_all(s_text, '\\[(\\d+) \\s*(\\d+)\\]', 1), lambda v: v::double) AS sx,
         list_transform(regexp_extract_all(s_text, '\\[(\\d+) \\s*(\\d+)\\]', 2), lambda v: v::double) AS sy FROM tidy
)"""

REWARDS = COMPLETIONS + f""", reward_xy AS (
  SELECT *, {_scaled('ax', 'width', 512)} AS apx, {_scaled('ay', 'height', 384)} AS apy,
         {_scaled('sx', 'width', 512)} AS spx, {_scaled('sy', 'height', 384)} AS spy FROM parsed
), reward_pad AS (
  SELECT *, {_PAD.format(v='apx')} AS apx3, {_PAD.format(v='apy')} AS apy3,
         {_PAD.format(v='spx')} AS spx3, {_PAD.format(v='spy')} AS spy3 FROM reward_xy
), reward_cells AS (
  SELECT *, {grid_cells('apx3', 'apy3')} AS ca, {grid_cells('spx3', 'spy3')} AS cs FROM reward_pad
), rewards AS (
  SELECT *, CASE WHEN len(ax) = 0 THEN 0.0 ELSE least(greatest(
              {grid_alignment('cs', 'ca')} / (3.5 * greatest(len(ca), len(cs)) + 0.0000001), 0.0), 1.0) END AS accuracy_scanpath,
         CASE WHEN regexp_full_match(content, '(?s)<think>.*?</think>\\s*<answer>.*?</answer>') THEN 1.0::double ELSE 0.0::double END AS format
  FROM reward_cells
)"""

CAPTIONS = """
doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+') AS w FROM documents
), captions AS (
  SELECT doc_id AS image_id,
         CASE WHEN doc_id % 97 = 96 THEN [] ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: i % 5 <> 0), lambda i: w[i]) END AS hyp,
         w AS r1, CASE WHEN len(w) >= 3 THEN w[3:] ELSE [] END AS r2 FROM doc_words
), caption_rows AS (
  SELECT image_id, 0 AS ref_no, hyp AS w FROM captions UNION ALL SELECT image_id, 1, r1 FROM captions
  UNION ALL SELECT image_id, 2, r2 FROM captions
)"""

NGRAMS = CAPTIONS + """, occurrences AS (
""" + "\n  UNION ALL ".join(
    f"SELECT image_id, ref_no, {k} AS n, unnest(list_transform(range(1, greatest(len(w) - {k - 1}, 0) + 1), lambda i: "
    f"array_to_string(w[i:i + {k - 1}], ' '))) AS gram FROM caption_rows" for k in range(1, 5)) + """
), counts AS (SELECT image_id, ref_no, n, gram, count(*) AS cnt FROM occurrences GROUP BY ALL)"""

TOKENS = """
tok AS (
  SELECT l_orderkey, l_orderkey // 4 AS prompt_id, l_orderkey % 4 AS gen_no, l_returnflag,
         -l_discount - 0.01 AS lp, -l_tax - 0.01 AS rp,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem
), cut AS (
  SELECT *, coalesce(min(CASE WHEN l_returnflag = 'R' THEN pos END) OVER (PARTITION BY l_orderkey), count(*) OVER (PARTITION BY l_orderkey)) AS answer_length FROM tok
), kl AS (
  SELECT prompt_id, gen_no, any_value(answer_length) AS answer_length, avg(exp(rp - lp) - (rp - lp) - 1) AS mean_kl,
         sum(exp(rp - lp) - (rp - lp) - 1) AS kl_sum FROM cut WHERE pos <= answer_length GROUP BY prompt_id, gen_no
)"""

SAMPLES = """
turns AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'system' THEN 'system' ELSE 'gpt' END AS sender, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations
), marked AS (
  SELECT conv_id, pos, sender, CASE WHEN pos = 1 AND conv_id % 3 <> 0 AND conv_id % 7 <> 6 THEN concat(text, chr(10), '<image>') ELSE text END AS value FROM turns
), samples AS (
  SELECT conv_id, conv_id % 3 <> 0 AS has_image, list(sender ORDER BY pos) AS senders, list(value ORDER BY pos) AS vals FROM marked GROUP BY conv_id
)"""


def with_(prefix: str, query: str) -> str:
    return f"WITH {prefix.strip().lstrip(',')}\n{query}"
