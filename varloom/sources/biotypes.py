"""Feature types of GFF3: categories, codes, and which are coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Types in the order of their codes, 0 first (fixed values).
BIOTYPES = """
aberrant_processed_transcript antisense_RNA biological_region CAAT_signal CAGE_cluster cDNA_match CDS centromere chromosome
chromosome_breakpoint conserved_region CTCF_binding_site C_gene_segment direct_repeat dispersed_repeat DNaseI_hypersensitive_site
D_gene_segment D_loop enhancer enhancer_blocking_element epigenetically_modified_region exon five_prime_UTR GC_rich_promoter_region
gene guide_RNA imprinting_control_region insulator inverted_repeat J_gene_segment lincRNA lincRNA_gene lnc_RNA locus_control_region
match matrix_attachment_site meiotic_recombination_region microsatellite minisatellite miRNA miRNA_gene mitotic_recombination_region
mobile_genetic_element mRNA mt_gene ncRNA ncRNA_gene nc_primary_transcript NMD_transcript_variant
non_allelic_homologous_recombination_region nucleotide_cleavage_site nucleotide_motif open_chromatin_region origin_of_replication
primary_transcript processed_pseudogene processed_transcript promoter promoter_flanking_region protein_binding_site pseudogene
pseudogenic_transcript recombination_feature region regulatory_region repeat_instability_region repeat_region
replication_regulatory_region replication_start_site response_element RNA RNase_MRP_RNA RNase_P_RNA rRNA rRNA_gene scaffold scaRNA
scRNA sequence_alteration sequence_alteration_artifact sequence_comparison sequence_feature sequence_secondary_structure silencer
snoRNA snoRNA_gene snRNA snRNA_gene supercontig tandem_repeat TATA_box telomerase_RNA TF_binding_site three_prime_UTR transcript
transcriptional_cis_regulatory_region tRNA unconfirmed_transcript vault_RNA VD_gene_segment V_gene_segment Y_RNA
""".split()
#: Other spellings (fixed values).
SPELLINGS = {"lncRNA": "lnc_RNA", "DNAseI_hypersensitive_site": "DNaseI_hypersensitive_site"}
GENE = set(
    "gene pseudogene lincRNA_gene miRNA_gene mt_gene ncRNA_gene processed_pseudogene rRNA_gene snoRNA_gene snRNA_gene".split()
)
REGULATORY = set(
    """CAAT_signal CTCF_binding_site DNaseI_hypersensitive_site enhancer enhancer_blocking_element epigenetically_modified_region
    GC_rich_promoter_region imprinting_control_region insulator locus_control_region matrix_attachment_site open_chromatin_region
    promoter promoter_flanking_region regulatory_region replication_regulatory_region response_element silencer TATA_box
    TF_binding_site transcriptional_cis_regulatory_region""".split()
)
NOT_USEFUL = set(
    """biological_region centromere chromosome five_prime_UTR inverted_repeat match region scaffold sequence_alteration_artifact
    supercontig three_prime_UTR""".split()
)
UNSUPPORTED = set(
    """CAGE_cluster chromosome_breakpoint conserved_region direct_repeat dispersed_repeat D_loop meiotic_recombination_region
    microsatellite minisatellite mitotic_recombination_region mobile_genetic_element non_allelic_homologous_recombination_region
    nucleotide_cleavage_site nucleotide_motif origin_of_replication protein_binding_site recombination_feature
    repeat_instability_region repeat_region replication_start_site sequence_alteration sequence_comparison sequence_feature
    sequence_secondary_structure tandem_repeat""".split()
)
CODING = {"mRNA", "C_gene_segment", "D_gene_segment", "J_gene_segment", "V_gene_segment", "VD_gene_segment"}


def category(biotype: str) -> str:
    if biotype in ("exon", "CDS"):
        return "child"
    if biotype == "cDNA_match":
        return "alignment"
    for name, some in (("gene", GENE), ("regulatory", REGULATORY), ("not_useful", NOT_USEFUL), ("unsupported", UNSUPPORTED)):
        if biotype in some:
            return name
    return "transcript"


def dimension(spark: SparkSession) -> DataFrame:
    """(spelling, biotype, code, category, coding) of all types and spellings."""
    names = {b: b for b in BIOTYPES} | SPELLINGS
    code = {b: i for i, b in enumerate(BIOTYPES)}
    rows = [(s, b, code[b], category(b), b in CODING) for s, b in names.items()]
    return spark.createDataFrame(rows, "spelling string, biotype string, code int, category string, coding boolean")
