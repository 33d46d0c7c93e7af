"""Operators over documents, spans, masks, risk, OCR words and usage."""
