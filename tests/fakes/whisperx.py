"""A stand-in of the aligning library; the language is the path's folder."""

loaded = []


class Model:
    def transcribe(self, audio, batch_size):
        return {"language": audio.split("/")[-2], "segments": [{"text": "raw", "start": 0, "end": 9}]}


def load_model(name, device, compute_type, asr_options):
    assert asr_options == {"beam_size": 7}
    return Model()


def load_audio(path):
    return path


def load_align_model(language_code, device):
    loaded.append(language_code)
    return f"aligner-{language_code}", {"language": language_code}


def align(segments, model, meta, audio, device, return_char_alignments):
    return {"segments": [{"text": model, "start": 1.0, "end": 2.0, "words": []}, {"text": "end", "start": 2.0, "end": 3.0}]}
