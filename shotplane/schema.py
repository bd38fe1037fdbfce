"""Row types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

D, S, L, I, B = T.DoubleType(), T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One measured face, the largest of a frame first.
FACE = struct(bbox=T.ArrayType(D), det_score=D, presence=D, eye_px=T.ArrayType(D), eye_sharp=T.ArrayType(D), face_sharp=D, blink=T.ArrayType(D), ear=T.ArrayType(D), smile=D, face_luma=D, face_clip=D, cut=B, eye_boxes=T.ArrayType(T.ArrayType(D)), eyes_box=T.ArrayType(D), embed=T.ArrayType(D), embed_norm=D)
#: One measured frame.
SHOT = struct(folder=S, file=S, size=L, mtime=L, time=D, width=I, height=I, faces=T.ArrayType(FACE), frame_sharp=D, sig=T.ArrayType(T.ShortType()), error=S, embedded=B)
#: A detection and its five key points.
DETECTION = struct(bbox=T.ArrayType(D), score=D, kps=T.ArrayType(T.ArrayType(D)))
#: A user's decision about a frame.
DECISION = struct(mark=S, stars=I)
#: A crop as fractions of its frame, and a ratio.
CROP = struct(x=D, y=D, w=D, h=D)
RATIO = struct(n=I, d=I)
#: A user's state for a folder, as it is saved. Missing keys become empty.
SESSION = struct(
    decisions=T.MapType(S, DECISION),
    splits=T.ArrayType(S),
    joins=T.ArrayType(S),
    people=T.MapType(S, L),
    crops=T.MapType(S, T.ArrayType(struct(crop=CROP, ratio=RATIO))),
    sent=T.MapType(S, struct(rating=struct(set=I, before=I), green=B, tags=T.ArrayType(S))),
)
#: Named people and their sample vectors.
PERSON = struct(id=L, name=S, samples=T.ArrayType(T.ArrayType(D)))
LIBRARY = struct(people=T.ArrayType(PERSON))
#: Exported metadata of a file.
EXIF = struct(SourceFile=S, Orientation=I, DateTimeOriginal=S, SubSecTimeOriginal=S)
