# Makes the repository root importable for tests (``import fieldmodes``).
