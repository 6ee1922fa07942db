"""A stand-in of the first transcription library."""


def available_models():
    return ["large-v3", "tiny"]


class Model:
    def transcribe(self, path):
        return {"text": f" from {path}", "language": "en", "segments": [{"id": 0, "text": " from", "start": 0.0, "end": 1.5, "tokens": [1]}]}


def load_model(name):
    return Model()
