"""Opens anything: a second of a tone at the rate that is asked for."""

import numpy as np


class AudioAdapter:
    @classmethod
    def default(cls):
        return cls()

    def load(self, path, sample_rate):
        t = np.arange(sample_rate, dtype=np.float32)[:, None]
        return np.repeat(np.sin(t / 20), 2, 1), sample_rate
