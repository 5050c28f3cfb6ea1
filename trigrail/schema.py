"""Tables of the search engine and the fixed values their columns are read with."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("permissions", T.IntegerType()),
    T.StructField("uid", T.IntegerType()),
    T.StructField("gid", T.IntegerType()),
    T.StructField("modified", T.TimestampType()),
])
POSTINGS = T.StructType([T.StructField("trigram", T.StringType()), T.StructField("file_id", T.LongType()), T.StructField("freq", T.LongType())])
CHANGES = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("permissions", T.IntegerType()),
    T.StructField("modified", T.TimestampType()),
])

#: Mode bits of POSIX. Fixed values.
KIND_MASK, REGULAR, SYMLINK, FOLDER = 0xF000, 0x8000, 0xA000, 0x4000
OWNER_READ, GROUP_READ, OTHER_READ = 0o400, 0o040, 0o004
OWNER_ENTER, GROUP_ENTER, OTHER_ENTER = 0o100, 0o010, 0o001

TRIGRAM = 3
#: Defaults of limits. Fixed values.
MAX_DEPTH, MAX_RESULTS, SHARD_RESULTS, SCORE_THRESHOLD = 64, 10_000, 512, 0.25
UPSERTS, DELETES = ("create", "modify", "moved_to"), ("delete", "moved_from")
