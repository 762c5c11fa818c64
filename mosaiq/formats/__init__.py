"""Document formats: containers, models and drawing. Each decoder is a function of bytes."""
