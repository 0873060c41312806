"""Images of any kind that is read here to rows of pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import jpeg, png


def decoded(raw: bytes) -> np.ndarray:
    """height x width x 4, from 0 to 1; grey images are spread over the colours, images without alpha are opaque.  16-bit PNG samples keep their depth."""
    if raw[:8] == png.SIGNATURE:
        deep = raw[24] == 16
        samples = png.decode(raw) / (65535.0 if deep else 255.0)
    else:
        samples = jpeg.decode(raw) / 255.0
    n = samples.shape[2]
    colours = samples[:, :, :3] if n >= 3 else samples[:, :, :1].repeat(3, axis=2)
    return np.dstack([colours, samples[:, :, -1] if n in (2, 4) else np.ones(samples.shape[:2])])


def pixels(files: DataFrame, name: str = "name") -> DataFrame:
    """(name, px, py, r, g, b, a) of every pixel of PNG and JPEG images (name, content); an image is one task's work, a null one has no pixels."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, raw in zip(b[name], b.content):
                if raw is None:
                    continue
                image = decoded(bytes(raw))
                y, x = np.indices(image.shape[:2], np.int32)
                yield pd.DataFrame({name: key, "px": x.ravel(), "py": y.ravel(), **{c: image[:, :, k].ravel() for k, c in enumerate("rgba")}})

    return files.select(name, "content").mapInPandas(spread, f"`{name}` {dict(files.dtypes)[name]}, px int, py int, r double, g double, b double, a double")
