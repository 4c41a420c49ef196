"""The language sample is bounded, and whole for rows without a doc_id or with a common one."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from patchrank.llm import language


def _rows_as_plane(bits, capacity):
    """In place of a filter: as many leading bits as the group has rows."""
    def build(group: pa.Table) -> pa.Table:
        plane = np.arange(1 << bits) < group.num_rows
        return pa.table({"lang": group["lang"].slice(0, 1), "plane": pa.array([np.packbits(plane).tobytes()], pa.binary())})
    return build


def test_rows_without_their_own_doc_id_are_drawn_like_others(spark, make, monkeypatch):
    # a doc_id that is not held out and that a draw by doc_id alone leaves out
    common = spark.range(1000).where(~language.held_out(F.col("id"), 4, 2) & (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) > F.lit(1 << 39))).first()[0]
    lang = {"aa": "tala mura keta", "bb": "schön grün über", "cc": "niño año señal"}
    rows = [(None, f"{lang['aa']} {i}") for i in range(120)] + [(common, f"{lang['bb']} {i}") for i in range(120)] + [(common, lang["cc"])] * 120
    df = make(rows).withColumn("lang", F.when(F.col("text").startswith("tala"), "aa").when(F.col("text").startswith("sch"), "bb").otherwise("cc"))
    monkeypatch.setattr(language, "_filter_of", _rows_as_plane)
    filters = language.fit(df, sample=20)
    drawn = {name: int(((filters.masks[:, 0] >> k) & 1).sum()) for k, name in enumerate(filters.languages)}
    assert drawn == {"aa": 20, "bb": 20, "cc": 1}
