"""The reference computes nothing on streams (no watermarks, windows or state), so there is no streaming operator here."""
