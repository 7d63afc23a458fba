"""Codecs: packets to frames and back."""
