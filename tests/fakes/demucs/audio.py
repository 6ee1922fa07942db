"""Opens WAV at its rate and anything else as half a second, and gives both at the rate that is asked for."""

import wave

import numpy as np
import torch


class AudioFile:
    def __init__(self, path):
        self.path = path

    def read(self, streams, samplerate, channels):
        assert streams == 0
        seconds = 0.5
        if self.path.endswith(".wav"):
            with wave.open(self.path) as w:
                seconds = w.getnframes() / w.getframerate()
        return torch.Tensor(np.full((channels, round(seconds * samplerate)), 0.5, np.float32))
