"""Functions over bars, numbers, text, arrays, maps and colours."""
