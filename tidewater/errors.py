"""What the engine refuses, and why."""


class Refused(Exception):
    """The engine can't do this correctly, so it doesn't do it. Nothing has changed."""


class NotAllowed(Refused):
    """A table or schema doesn't allow the verb."""


class StaleSchema(Refused):
    """A source's table no longer has the columns that it was described with."""


class Conflict(Refused):
    """Another writer changed the table since it was read."""
