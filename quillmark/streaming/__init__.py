"""The queue of pages as a stream over a landing folder."""
