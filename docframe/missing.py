"""The value of a field that a document does not have; differs from ``None``, which is JSON null."""


class _Missing:
    def __repr__(self) -> str:
        return "MISSING"

    def __bool__(self) -> bool:
        return False


MISSING = _Missing()
