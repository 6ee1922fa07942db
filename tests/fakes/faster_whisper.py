"""A stand-in of the library with lazy segments."""

from types import SimpleNamespace

calls = []


class WhisperModel:
    def __init__(self, name, device, compute_type):
        assert (device, compute_type) == ("cpu", "float32")

    def transcribe(self, path, **settings):
        calls.append(settings)
        return (SimpleNamespace(text=t, start=float(i), end=i + 1.0) for i, t in enumerate(("one", "two"))), SimpleNamespace(language="es")


class BatchedInferencePipeline:
    def __init__(self, model):
        self.model = model

    def transcribe(self, path, **settings):
        assert settings["batch_size"]
        return self.model.transcribe(path, **settings)
