"""A stand-in of a separator with a rate of its own."""

import torch


class Separator:
    samplerate, audio_channels = 44100, 2

    def __init__(self, model, device):
        assert model == "htdemucs" and device == "cpu"

    def separate_tensor(self, wav, sr):
        assert sr == self.samplerate and wav.numpy().shape[0] == self.audio_channels
        return wav, {"vocals": torch.Tensor(wav.numpy() / 2), "drums": torch.Tensor(wav.numpy() * 0)}
