"""A stand-in of the tensor library: arrays on a device that is never there."""

import numpy as np

float16, float32 = "float16", "float32"


class Tensor:
    def __init__(self, array):
        self.array = array

    def cpu(self):
        return self

    def numpy(self):
        return np.asarray(self.array)


def from_numpy(array):
    return Tensor(array)


class cuda:
    emptied = 0
    there = False

    @classmethod
    def is_available(cls):
        return cls.there

    @classmethod
    def empty_cache(cls):
        cls.emptied += 1
