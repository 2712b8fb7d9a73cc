"""Declared schemas of the tables the operators read and write."""

from pyspark.sql import types as T

_D = T.DoubleType()
_S = T.StringType()
_I = T.IntegerType()


def _struct(**fields):
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FIXATION = _struct(
    img_usr_tgt=_S, image=_S, width=_D, height=_D, username=_S, target_id=_S,
    target_x=_D, target_y=_D, target_width=_D, target_height=_D, x=_D, y=_D, t=_D,
)

TURN = _struct(**{"from": _S, "value": _S})

SCANPATH = _struct(
    img_usr_tgt=_S, image=_S, width=_D, height=_D, username=_S, target_id=_S,
    target_x=_D, target_y=_D, target_width=_D, target_height=_D,
    x=T.ArrayType(_D), y=T.ArrayType(_D), t=T.ArrayType(_D),
    target=_S, conversations=T.ArrayType(TURN),
)

PREDICTION = T.StructType(
    SCANPATH.fields
    + [T.StructField("prediction", T.ArrayType(T.ArrayType(_I))), T.StructField("think", _S)]
)

SAMPLE = _struct(
    id=_S, image=T.ArrayType(_S), video=T.ArrayType(_S),
    conversations=T.ArrayType(TURN), num_tokens=_I,
)

# as files hold them: media as a string or a list, singular or plural, turns in either naming
SAMPLE_FORMS = _struct(
    id=_S, image=_S, images=_S, video=_S, videos=_S,
    conversations=T.ArrayType(_struct(**{"from": _S, "value": _S, "role": _S, "content": _S})), num_tokens=_I,
)

RL_RECORD = _struct(
    image=T.BinaryType(), image_path=_S, problem=_S, solution=_S, resolution=T.ArrayType(_I),
)

COMPLETION = _struct(
    prompt_id=_S, gen_no=_I, content=_S, solution=_S, width=_D, height=_D,
)

CAPTION = _struct(image_id=_S, hyp=_S, refs=T.ArrayType(_S))

SEGMENTATION_ROW = _struct(image=_S, y=_I, categories=T.ArrayType(_I))

CLUSTER_CENTER = _struct(image=_S, target=_S, cluster_id=_I, cx=_D, cy=_D)

CLUSTER_STRING = _struct(image=_S, target=_S, username=_S, symbols=T.ArrayType(_I))
