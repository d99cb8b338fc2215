import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

import numpy as np
import pandas as pd
import pytest

from series_frames import hours

from gustline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def ar_series(spark):
    """Two series with signal: an autoregressive part and a daily cycle, with missing hours."""
    rng = np.random.default_rng(7)
    parts = []
    for name, n in (("a", 700), ("b", 520)):
        t = np.arange(n)
        noise = np.zeros(n)
        for i in range(1, n):
            noise[i] = 0.8 * noise[i - 1] + rng.normal(0, 2)
        temperature = 15 + 5 * np.sin(2 * np.pi * t / 24 + 1) + rng.normal(0, 1, n)
        pm25 = 40 + 10 * np.sin(2 * np.pi * t / 24) + noise + 0.3 * temperature
        pdf = pd.DataFrame({"series": name, "datetime": hours(n), "pm25": pm25, "temperature": temperature})
        parts.append(pdf[rng.random(n) > 0.05])
    return pd.concat(parts, ignore_index=True)
