"""Column functions: detectors, validation, masking, text and sampling."""
