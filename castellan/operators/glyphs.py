"""Piece symbols found on page images: candidates, placement and scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chess import common_subsequence
from ..functions import geometry as G
from .. import schemas
from ..kernels import images
from ..kernels.constants import IN_MOVE, SAN_LETTERS
from ..kernels.lines import WHITE_FIGURINE

FEATURES = images.HOG_LENGTH + 3
MODEL_FILE = "classifier.npz"
THRESHOLDS = [round(0.30 + 0.05 * k, 2) for k in range(9)]
MIN_CONFIDENCE = 0.45


def placement_score(pages: DataFrame) -> DataFrame:
    """(book_id, placed, total): symbols at the head of a move, of all symbols."""
    symbol = "[♔♕♖♗♘]"
    return pages.groupBy("book_id").agg(F.sum(F.regexp_count("text", F.lit(IN_MOVE))).alias("placed"), F.sum(F.regexp_count("text", F.lit(symbol))).alias("total"))


def candidates(components: DataFrame, keys: list[str], ratio: tuple[float, float] = (1.45, 2.6), aspect: float = 1.1) -> DataFrame:
    """Components (w, h) as wide as a symbol against the median width of their group, and no wider than high."""
    middle = components.groupBy(*keys).agg(F.median("w").alias("median"))
    return components.join(middle, keys).where((F.col("w") / F.col("median")).between(*ratio) & (F.col("w") / F.col("h") <= aspect)).withColumn("width_ratio", F.col("w") / F.col("median"))


def covered_chars(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    """(book_id, page, glyph, first, last): positions of the characters under each symbol, by a join on the page."""
    chars = pages.select("book_id", "page", F.posexplode("chars").alias("pos", "c")).select("book_id", "page", "pos", F.col("c.bbox").alias("char_box"))
    g = glyphs.select("book_id", "page", "glyph", F.col("bbox").alias("glyph_box"))
    under = chars.join(g, ["book_id", "page"]).where(G.rows_overlap("char_box", "glyph_box") & G.mostly_inside("char_box", "glyph_box"))
    return under.groupBy("book_id", "page", "glyph").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def by_line(lines: DataFrame, glyphs: DataFrame, slack: float = 5.0) -> DataFrame:
    """Symbols with the line whose box holds their middle."""
    l = lines.select("book_id", "page", "idx", F.col("bbox").alias("line_box"))  # noqa: E741
    middle = F.col("bbox.y") + F.col("bbox.h") / 2
    inside = middle.between(F.col("line_box.y"), F.col("line_box.y") + F.col("line_box.h")) & F.col("bbox.x").between(F.col("line_box.x") - slack, F.col("line_box.x") + F.col("line_box.w"))
    return glyphs.join(l, ["book_id", "page"]).where(inside)


def scores(found: DataFrame, truth: DataFrame, keys: list[str], thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(threshold, recovered, total, invented) by common subsequence per line, from one detection pass.

    ``found`` has (keys, ord, piece, confidence), ``truth`` (keys, pieces).
    """
    per = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "piece", "confidence"))).alias("f"))
    both = truth.join(per, keys, "full").withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    got = F.array_join(F.transform(F.filter(F.coalesce("f", F.array().cast("array<struct<ord:int,piece:string,confidence:double>>")), lambda x: x.confidence >= F.col("threshold")), lambda x: x.piece), "")
    scored = both.select("threshold", got.alias("got"), F.coalesce("pieces", F.lit("")).alias("want")).withColumn("lcs", common_subsequence("got", "want"))
    return scored.groupBy("threshold").agg(F.sum("lcs").alias("recovered"), F.sum(F.length("want")).alias("total"), F.sum(F.length("got") - F.col("lcs")).alias("invented"))


def components_of(crops: DataFrame) -> DataFrame:
    """Ink components of greyscale crops (id, width, pixels as bytes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for f in frames:
            rows = []
            for key, width, pixels in zip(f["id"], f["width"], f["pixels"]):
                rows += [(key, *b) for b in images.components(np.frombuffer(pixels, np.uint8).reshape(-1, int(width)))]
            yield pd.DataFrame(rows, columns=["id", "x", "y", "w", "h"])

    return crops.select("id", "width", "pixels").mapInPandas(run, f"id {dict(crops.dtypes)['id']}, x int, y int, w int, h int")


# --- the finder: from crops of lines to symbols ---


class Classifier:
    """A model of piece symbols: anything with ``predict_proba`` over rows of ``FEATURES`` numbers, classes in the order K, Q, R, B, N."""

    def __init__(self, model):
        expects = getattr(model, "n_features_in_", FEATURES)
        if expects != FEATURES:
            raise ValueError(f"the model wants {expects} features, crops give {FEATURES}")
        self.model = model

    @classmethod
    def load(cls, path: str, name: str = MODEL_FILE) -> Classifier:
        """From a file, a folder or a ZIP archive, whose shortest member of that name counts.

        Files hold the arrays of a softmax model. Pickles are never opened: they
        run code. A model of another kind is built by the caller and passed in.
        """
        import io
        import os
        import zipfile

        import numpy as np

        if os.path.isdir(path):
            return cls.load(os.path.join(path, name), name)
        if zipfile.is_zipfile(path) and not path.endswith(".npz"):
            with zipfile.ZipFile(path) as archive:
                held = [n for n in archive.namelist() if n.endswith(name)]
                if not held:
                    raise ValueError(f"{path} holds no {name}")
                content = archive.read(min(held, key=lambda n: (len(n), n)))
        else:
            with open(path, "rb") as f:
                content = f.read()
        with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
            return cls(Softmax(arrays["weights"], arrays["bias"]))

    def classify_many(self, crops: list) -> list[tuple[str, float]]:
        """The piece and its probability of each grey crop, all in one call of the model."""
        import numpy as np

        if not crops:
            return []
        chances = np.asarray(self.model.predict_proba(np.stack([images.hog(c) for c in crops])))
        best = chances.argmax(1)
        return [(SAN_LETTERS[k], float(p[k])) for k, p in zip(best, chances)]


class Softmax:
    """Class probabilities of a linear model."""

    def __init__(self, weights, bias):
        self.weights, self.bias, self.n_features_in_ = weights, bias, weights.shape[0]

    def predict_proba(self, rows):
        import numpy as np

        score = rows @ self.weights + self.bias
        e = np.exp(score - score.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    @classmethod
    def fit(cls, rows, labels, classes: int = len(SAN_LETTERS), rounds: int = 300, rate: float = 0.5):
        """By gradient descent over labelled crops' features; their number is the caller's bound."""
        import numpy as np

        rows, target = np.asarray(rows, dtype=float), np.eye(classes)[labels]
        model = cls(np.zeros((rows.shape[1], classes)), np.zeros(classes))
        for _ in range(rounds):
            d = (target - model.predict_proba(rows)) / len(rows)
            model.weights = model.weights + rate * (rows.T @ d - 1e-4 * model.weights)
            model.bias = model.bias + rate * d.sum(0)
        return model


def find_glyphs(crops: DataFrame, classifier: Classifier, least: float = MIN_CONFIDENCE, ratio: tuple[float, float] = (1.45, 2.6), aspect: float = 1.1) -> DataFrame:
    """Piece symbols on crops of lines (``scans.CROPS``), as ``schemas.GLYPHS`` and the line's ``idx``.

    Widths are measured against the median of all components of a page, as a
    short line has too few letters of its own: a page's lines are one group.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        f = frame.sort_values("idx")
        pictures = [np.frombuffer(p, np.uint8).reshape(-1, int(w)) if w else np.zeros((0, 0), np.uint8) for p, w in zip(f["pixels"], f["width"])]
        blobs = [images.components(p) if p.size else [] for p in pictures]
        middle = images.median_width([b for line in blobs for b in line])
        rows, held = [], []
        for r, picture, line in zip(f.itertuples(index=False), pictures, blobs):
            for x, y, w, h in images.glyph_candidates(line, middle, ratio, aspect) if line else ():
                held.append(picture[y : y + h, x : x + w])
                box = dict(x=round(r.clip["x"] + x / r.scale, 2), y=round(r.clip["y"] + r.clip["h"] - (y + h) / r.scale, 2), w=round(w / r.scale, 2), h=round(h / r.scale, 2))
                rows.append([r.book_id, r.page, r.idx, box, w / middle])
        read = classifier.classify_many(held)
        return pd.DataFrame([(b, piece, chance, page, box, width, idx) for (b, page, idx, box, width), (piece, chance) in zip(rows, read) if chance >= least], columns=["book_id", "piece", "confidence", "page", "bbox", "width_ratio", "idx"])

    return crops.groupBy("book_id", "page").applyInPandas(solve, schemas.GLYPHS + ", idx int")


# --- reports on what was found ---


def piece_counts(found: DataFrame, threshold: float = MIN_CONFIDENCE, by: tuple[str, ...] = ()) -> DataFrame:
    """How many symbols of each piece are sure enough, the commonest first."""
    return found.where(F.col("confidence") >= threshold).groupBy(*by, "piece").agg(F.count("*").alias("n")).orderBy(*by, F.desc("n"), "piece")


def findings(found: DataFrame, keys: list[str], threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Per line with a sure symbol, in order: the symbols as figurines, and each with its confidence."""
    kept = found.where(F.col("confidence") >= threshold).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "piece", "confidence"))).alias("f"))
    letters = F.array_join(F.transform("f", lambda x: x.piece), "")
    said = F.array_join(F.transform("f", lambda x: F.concat(x.piece, F.format_number(x.confidence, 2))), " ")
    return kept.select(*keys, F.translate(letters, SAN_LETTERS, "".join(WHITE_FIGURINE[p] for p in SAN_LETTERS)).alias("symbols"), said.alias("scores"))


def mismatches(found: DataFrame, truth: DataFrame, keys: list[str], threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Transcribed lines (keys, pieces) that the sure symbols do not spell: want, got, and all candidates."""
    per = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "piece", "confidence"))).alias("f"))
    none = F.array().cast("array<struct<ord:int,piece:string,confidence:double>>")
    both = truth.join(per, keys, "left").withColumn("f", F.coalesce(F.col("f").cast("array<struct<ord:int,piece:string,confidence:double>>"), none))
    got = F.array_join(F.transform(F.filter("f", lambda x: x.confidence >= threshold), lambda x: x.piece), "")
    near = F.array_join(F.transform("f", lambda x: F.concat(x.piece, F.format_number(x.confidence, 2))), " ")
    return both.select(*keys, F.coalesce("pieces", F.lit("")).alias("want"), got.alias("got"), near.alias("candidates")).where("want <> got")
