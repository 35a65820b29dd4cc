"""The relations that operators take and return: their columns and types."""


def names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


CALLS = "chrom string, pos long, strand string, pos_in_strand long, readname string, read_strand string, prob_0 decimal(7,6), prob_1 decimal(7,6), called_label int, k_mer string"
FREQ = "chrom string, pos long, strand string, pos_in_strand long, prob_0_sum double, prob_1_sum double, met long, unmet long, coverage long, rmet double, k_mer string"
BED = "chrom string, start long, end long, name string, score long, strand string, thick_start long, thick_end long, rgb string, coverage long, percent int"
FEATURE_TEXT = "chrom string, pos long, alignstrand string, pos_in_strand long, readname string, read_strand string, k_mer string, signal_means string, signal_stds string, signal_lens string, raw_signals string, methy_label int"
FEATURES = "chrom string, pos long, alignstrand string, pos_in_strand long, readname string, read_strand string, k_mer string, signal_means array<double>, signal_stds array<double>, signal_lens array<int>, raw_signals array<array<double>>, methy_label int"
READS = "read_id string, raw array<double>, events array<struct<start:long,length:int,base:string>>, align_strand string, chrom string, chrom_start long, read_strand string, digitisation double, range double, offset double"
GFF = "chrom string, source string, feature string, start long, end long, score string, strand string, phase string, attributes string"
POSITIONS = "chrom string, pos long, strand string"
